"""Tables that Spark reads itself: Parquet folders, and DataFrames of the caller."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryTypeError
from ..plans.types import SPARK, Kind
from .csv_folder import within


def fitted(column: Column, kind: T.DataType) -> tuple[Column, Kind]:
    """A column as one of the language's types; what has none becomes text that can only be compared."""
    match kind:
        case T.ByteType() | T.ShortType() | T.IntegerType():
            found = Kind.INT
        case T.LongType():
            found = Kind.LONG
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            found = Kind.REAL
        case T.StringType():
            found = Kind.STRING
        case T.BooleanType():
            found = Kind.BOOL
        case T.TimestampNTZType() | T.DateType() | T.TimestampType():
            found = Kind.DATETIME
        case T.DayTimeIntervalType():
            found = Kind.TIMESPAN
        case T.ArrayType() | T.MapType() | T.StructType() | T.VariantType():
            return F.to_json(column), Kind.DYNAMIC
        case _:
            return column.cast("string"), Kind.DYNAMIC
    # No cast where there is none to make: filters on a cast aren't pushed down.
    return column if kind == SPARK[found] else column.cast(SPARK[found]), found


def places(frame: DataFrame, of_files: bool) -> list[Column]:
    """What tells the order of rows: of files their names and the rows' numbers, else the partitions."""
    if of_files:
        return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return [F.monotonically_increasing_id()]


def load(
    frame: DataFrame, table: str, time_column: str | None, dynamic: frozenset[str], start: datetime | None, end: datetime | None, order: list[Column] = []
) -> tuple[DataFrame, list[tuple[str, Kind]]]:
    """The rows of a time window, in columns called 0, 1, ..., and their names and types; ``order`` are further columns."""
    names = frame.columns
    made = [fitted(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields]
    columns = [(n, Kind.DYNAMIC if n in dynamic and kind is Kind.STRING else kind) for n, (_, kind) in zip(names, made)]
    rows = frame.select(*[column.alias(str(i)) for i, (column, _) in enumerate(made)], *[column.alias(f"place {i}") for i, column in enumerate(order)])
    if (start, end) != (None, None):
        if time_column not in names or dict(columns)[time_column] is not Kind.DATETIME:
            raise QueryTypeError(f"table {table!r} has no time column; only (*) is possible")
        rows = within(rows, str(names.index(time_column)), start, end)
    return rows, columns
