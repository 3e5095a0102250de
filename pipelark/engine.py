"""Running queries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .plans import parser
from .plans.compiler import compile_query, named
from .sources.catalog import Catalog


@dataclass(frozen=True)
class Column:
    """A result column: name, table it comes from (None if computed), and type."""

    name: str
    origin: str | None
    type: str


@dataclass(frozen=True)
class Result:
    """A checked query: its rows (not computed yet) and its columns, which are known for empty results as well."""

    frame: DataFrame
    columns: tuple[Column, ...]


def prepare(spark: SparkSession, text: str, catalog: Catalog, now: datetime | None = None, ordered: bool = False) -> Result:
    """Parse, check and plan a query.

    ``now`` is the clock that ``last`` and ``ago`` count from, in UTC; it is read
    once for the whole query if it isn't given.  With ``ordered`` rows have the
    order of their files and lines (of Parquet folders: of file names and rows, of
    DataFrames: of their partitions), which all stages keep: ``take`` gives the
    first rows, ``sort`` leaves equal rows in order, groups come in the order of
    their first rows.  That costs a sort at the end; otherwise rows have no order but
    that of a final ``sort``.
    """
    query = parser.parse(text)
    for table in sorted(query.tables()):
        catalog[table]  # all of them must be there before any is read
    moment = now or datetime.now(UTC).replace(tzinfo=None)
    relation = compile_query(query, lambda table, start, end: catalog[table].load(spark, start, end, ordered), moment, ordered)
    return Result(named(relation), tuple(Column(c.name, c.origin, c.kind.value) for c in relation.scope.columns))


def execute(spark: SparkSession, text: str, catalog: Catalog, now: datetime | None = None, ordered: bool = False) -> DataFrame:
    """The rows of a query as a DataFrame, which Spark computes when they are asked for."""
    return prepare(spark, text, catalog, now, ordered).frame


def explain(spark: SparkSession, text: str, catalog: Catalog, now: datetime | None = None, mode: str = "formatted", ordered: bool = False) -> str:
    """Spark's plan of a query."""
    frame = execute(spark, text, catalog, now, ordered)
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)
