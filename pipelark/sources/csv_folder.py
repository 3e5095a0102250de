"""Tables that are folders of CSV files.

A folder holds ``<table>.json``, which declares the columns, and files named
``YYYY-MM-DD_HH-MM-SS.mmm_<table>.csv`` after the time from which on they have
rows.  Files have no header, fields are quoted as in RFC 4180, and column 0 is
the time.  Lines end in \\n or \\r\\n, also within one file; carriage returns at the
end of a cell aren't kept.  From the names it is known which files a time window needs; only those
are given to Spark.  A cell that isn't written as its type demands is null.
"""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CatalogError, QueryTypeError
from ..functions import spans
from ..functions.scalars import instant
from ..plans.types import DECLARED, SPARK, Kind
from . import files

_STAMP = re.compile(r"(\d{4}-\d\d-\d\d)_(\d\d)-(\d\d)-(\d\d)\.(\d{3})")


def read_schema(text: str) -> list[tuple[str, Kind]]:
    """The columns that a schema file declares, in order."""
    try:
        declared = json.loads(text)["orderedColumns"]
        columns = [(c["name"], c["type"]) for c in declared]
    except (ValueError, KeyError, TypeError) as fault:
        raise CatalogError(f"not a schema file: {fault}") from fault
    if not columns:
        raise CatalogError("a schema must have columns")
    for name, kind in columns:
        if kind not in DECLARED:
            raise CatalogError(f"unknown type {kind!r} of column {name!r}")
    return [(name, DECLARED[kind]) for name, kind in columns]


def begins(name: str, table: str) -> datetime | None:
    """The time in a file's name, or None if it isn't a file of the table."""
    m = _STAMP.match(name)
    if not m or name[m.end() :] != f"_{table}.csv":
        return None
    try:
        return datetime.fromisoformat(f"{m[1]}T{m[2]}:{m[3]}:{m[4]}.{m[5]}")
    except ValueError:
        return None


def needed(names: list[str], table: str, start: datetime | None, end: datetime | None) -> list[str]:
    """The files that can have rows from ``start`` to ``end``, both included; None is open.

    A file goes on until the next one begins: the window begins in the last file
    that begins at or before ``start`` (or the first there is), and the last file
    it needs is the last that begins at or before ``end``.
    """
    found = sorted((stamp, name) for name in names if (stamp := begins(name, table)))
    first = 0 if start is None else max((i for i, (stamp, _) in enumerate(found) if stamp <= start), default=0)
    last = len(found) - 1 if end is None else max((i for i, (stamp, _) in enumerate(found) if stamp <= end), default=-1)
    return [name for _, name in found[first : last + 1]]


def cell(raw: Column, kind: Kind) -> Column:
    """A cell's text as its type, or null."""
    match kind:
        case Kind.INT:
            return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("int"))
        case Kind.REAL:
            number = raw.try_cast("double")
            endless = F.lit(float("inf"))
            usual = F.when(number.isin(endless, -endless), None).otherwise(number)
            small = F.lower(raw)
            return (
                F.when(raw.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), usual)
                .when(small.rlike(r"^[+-]?inf(inity)?$"), F.when(raw.startswith("-"), -endless).otherwise(endless))
                .when(small == "nan", F.lit(float("nan")))
            )
        case Kind.BOOL:
            return F.when(raw.isin("1", "t", "T", "TRUE", "true", "True"), True).when(raw.isin("0", "f", "F", "FALSE", "false", "False"), False)
        case Kind.DATETIME:
            return F.when(raw.rlike(r"^\d{4}-\d\d-\d\d \d{1,2}:\d\d:\d\d\.\d{3}$"), raw.try_cast("timestamp_ntz"))
        case Kind.TIMESPAN:
            return spans.parsed(raw)
    return F.nullif(raw, F.lit(""))


def texts(spark: SparkSession, columns: list[tuple[str, Kind]], multiline: bool, streaming: bool = False):
    """A reader of the files' cells as text, one column each, called 0, 1, ...

    Records may have line ends in quotes, so that files aren't split; a table
    without such records may be registered as not ``multiline``, and then is.
    """
    schema = T.StructType([T.StructField(str(i), T.StringType()) for i in range(len(columns))])
    reader = spark.readStream if streaming else spark.read
    # Left to itself, the parser takes the line end of the first record for that of all.
    reader = reader.option("lineSep", "\n") if multiline else reader
    return reader.schema(schema).options(header=False, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", enforceSchema=True, encoding="UTF-8")


def typed(raw: DataFrame, columns: list[tuple[str, Kind]]) -> DataFrame:
    """Cells as their types, in columns that are still called 0, 1, ..."""
    # Records end at \n, so that the other half of \r\n stays in the last cell that a record has.
    cells = [F.rtrim(F.col(f"`{i}`"), F.lit("\r")) for i in range(len(columns))]
    return raw.select(*[cell(c, kind).cast(SPARK[kind]).alias(str(i)) for i, (c, (_, kind)) in enumerate(zip(cells, columns))], *raw.columns[len(columns) :])


def within(frame: DataFrame, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; with neither, all rows."""
    bounds = [F.col(f"`{column}`") >= instant(start)] if start is not None else []
    bounds += [F.col(f"`{column}`") <= instant(end)] if end is not None else []
    return frame.filter(reduce(lambda a, b: a & b, bounds)) if bounds else frame


def _check_first_records(spark: SparkSession, folder: str, names: list[str], expected: int) -> None:
    """Refuse a file whose first record hasn't the expected number of fields; empty files pass."""

    def found(name: str) -> int:
        record = files.first_record(spark, f"{folder}/{name}")
        return expected if record is None else files.fields(record)

    with ThreadPoolExecutor(16) as pool:
        for name, number in zip(names, pool.map(found, names)):
            if number != expected:
                raise CatalogError(f"{name}: first row has {number} fields, expected {expected}")


def load(
    spark: SparkSession, folder: str, table: str, start: datetime | None, end: datetime | None, multiline: bool = True, check: bool = True, ordered: bool = False
) -> tuple[DataFrame, list[tuple[str, Kind]]]:
    """The rows of a time window, in columns called 0, 1, ..., and the declared columns.

    With ``check`` the first record of each file that is read must have as many
    fields as there are columns.  Later records may be shorter (the rest is null)
    or longer (the rest is left out).  With ``ordered`` further columns tell the
    order of files by their names, and that of their lines.
    """
    columns = read_schema(files.content(spark, f"{folder}/{table}.json"))
    if (start, end) != (None, None) and columns[0][1] is not Kind.DATETIME:
        raise QueryTypeError(f"table {table!r} has no time in its first column")
    selected = needed(files.names(spark, folder), table, start, end)
    if check:
        _check_first_records(spark, folder, selected, len(columns))
    if selected:
        raw = texts(spark, columns, multiline).csv([f"{folder}/{name}" for name in selected])
        if ordered:  # a task reads pieces of files one after another, and numbers its rows
            raw = raw.select("*", F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    else:
        raw = spark.createDataFrame([], T.StructType([T.StructField(str(i), T.StringType()) for i in range(len(columns))]))
        raw = raw.withColumn("line", F.lit(0)) if ordered else raw
    return within(typed(raw, columns), "0", start, end), columns
