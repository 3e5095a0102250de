"""Writing a table as a folder of CSV files that are named by time."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryTypeError
from ..plans.types import Kind
from . import files
from .csv_folder import texts
from .frames import fitted

#: Formats that cut times down to the period of a file.
PERIODS = {"day": "yyyy-MM-dd", "half-day": "yyyy-MM-dd a", "hour": "yyyy-MM-dd HH", "minute": "yyyy-MM-dd HH:mm"}


def _spelled(column: Column, kind: Kind) -> Column:
    """A value the way the files have it; null is an empty cell."""
    match kind:
        case Kind.DATETIME:
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS")
        case Kind.TIMESPAN:
            epoch = F.expr("TIMESTAMP'1970-01-01 00:00:00Z'")
            return F.concat(F.unix_micros(epoch + column).cast("string"), F.lit("us"))
        case Kind.BOOL:
            return F.when(column, "true").when(~column, "false")
    return column.cast("string")


def store(frame: DataFrame, folder: str, table: str, time_column: str, period: str = "day") -> None:
    """Write ``frame`` with its time column first: a schema file, and files for each period that has rows.

    A period is one file, or several where it has many rows: tasks get ranges of
    times, so that none gets more than its share.  A file is named after its
    first row, and its rows are in order of time.  Rows without a time aren't
    possible in this format and are refused.
    """
    spark = frame.sparkSession
    found = [(f.name, *fitted(F.col(f"`{f.name}`"), f.dataType)) for f in frame.schema.fields]
    found.sort(key=lambda c: c[0] != time_column)
    if not found or found[0][0] != time_column or found[0][2] is not Kind.DATETIME:
        raise QueryTypeError(f"{time_column!r} isn't a time column")
    kinds = {Kind.LONG: "real"}  # the format has no 64-bit whole numbers; those up to 2^53 are exact
    cells = [_spelled(c, kind).alias(name) for name, c, kind in found]
    time = found[0][1]
    part = F.date_format(time, PERIODS[period])
    checked = F.when(part.isNull(), F.raise_error(F.lit("a row without a time can't be stored"))).otherwise(part)
    draft = f"{folder}/.draft"
    # By the time as it is written: rows of one name can't be in two files.
    rows = frame.select(checked.alias("part"), cells[0].alias("at"), time.alias("time"), F.struct(*cells).alias("row"))
    ordered = rows.repartitionByRange("at").sortWithinPartitions("part", "time").select("part", "row.*")
    ordered.write.partitionBy("part").options(header=False, quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(draft, mode="overwrite")
    columns = [(name, kinds.get(kind, kind.value)) for name, _, kind in found]
    _settle(spark, draft, folder, table, len(columns))
    files.write(spark, f"{folder}/{table}.json", json.dumps({"name": table, "orderedColumns": [{"name": name, "type": kind} for name, kind in columns]}, indent=2))


def _settle(spark: SparkSession, draft: str, folder: str, table: str, width: int) -> None:
    """Give each file its name."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    system = Path(draft).getFileSystem(spark._jsc.hadoopConfiguration())
    if any(status.isDirectory() for status in system.listStatus(Path(draft))):
        written = texts(spark, [("", Kind.STRING)] * width, True).csv(draft)
        first = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("`0`").alias("at")).collect()
        for row in first:
            stamp = row["at"].replace(" ", "_").replace(":", "-")
            system.rename(Path(spark._jvm.java.net.URI(row["file"])), Path(f"{folder}/{stamp}_{table}.csv"))
    system.delete(Path(draft), True)
