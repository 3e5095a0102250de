"""Following a folder of CSV files that is still being written.

Files are append-only and named by time, so that a table can be read as a stream:
every new file is a new batch.  Filters, projections and joins with tables that
stand still work as in a query; so do summaries, whose results are updated.
Sorting and taking the first rows need all rows and are refused.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryTypeError
from ..plans import parser
from ..plans import syntax as S
from ..plans.compiler import compile_query, named
from ..sources import csv_folder, files
from ..sources.catalog import Catalog


def follow(spark: SparkSession, text: str, catalog: Catalog, now: datetime | None = None) -> DataFrame:
    """The rows of a query as a streaming DataFrame; its first table is the one that is followed.

    The first table must be of CSV files and be taken whole (``(*)``) or from a
    time on; a window's end, and ``last``, bound what has been written so far.
    """
    query = parser.parse(text)
    if refused := [type(s).__name__.lower() for s in query.stages if isinstance(s, S.Sort | S.Take)]:
        raise QueryTypeError(f"a stream has no '{refused[0]}'")
    entry = catalog[query.source.table]
    if entry.mode not in ("file", "blob"):
        raise QueryTypeError(f"table {entry.table!r} isn't a folder of CSV files")
    first = [True]

    def load(table: str, start: datetime | None, end: datetime | None):
        if not first:
            return catalog[table].load(spark, start, end)
        first.clear()
        if entry.mode == "blob":
            entry.unlock(spark)
        columns = csv_folder.read_schema(files.content(spark, f"{entry.folder()}/{entry.table}.json"))
        raw = csv_folder.texts(spark, columns, entry.multiline, streaming=True).option("pathGlobFilter", f"*_{entry.table}.csv").csv(entry.folder())
        return csv_folder.within(csv_folder.typed(raw, columns), "0", start, end), columns

    moment = now or datetime.now(UTC).replace(tzinfo=None)
    return named(compile_query(query, load, moment))
