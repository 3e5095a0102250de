"""A query to one relation, checked while it is made."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ago
from ..operators.stages import Context, Relation, apply
from . import syntax as S
from .scope import ColumnInfo, Keys, Scope
from .types import Kind

#: Rows of a table from one time to another, in columns called 0, 1, ..., and the names and types of these.  Further
#: columns tell the order of the rows, if it is wanted.
Loader = Callable[[str, datetime | None, datetime | None], tuple[DataFrame, list[tuple[str, Kind]]]]


def bounds(window, now: datetime) -> tuple[datetime | None, datetime | None]:
    """First and last time of a window; None is open."""
    match window:
        case S.Last(span):
            return ago(now, span), now
        case S.Range(start, end):
            return start, end
    return None, None


def compile_query(query: S.Query, load: Loader, now: datetime, ordered: bool = False) -> Relation:
    """Sources, stages and sub-queries of a query; all of them share ``now``.  Rows have an order if ``ordered``."""
    keys = Keys()

    def compiled(part: S.Query) -> Relation:
        frame, columns = load(part.source.table, *bounds(part.source.window, now))
        found = [ColumnInfo(name, part.source.table, kind, keys.new()) for name, kind in columns]
        places = [(name, keys.new()) for name in frame.columns[len(found) :]]
        selected = [F.col(f"`{i}`").alias(c.key) for i, c in enumerate(found)] + [F.col(f"`{name}`").alias(key) for name, key in places]
        relation = Relation(frame.select(*selected), Scope(tuple(found)), tuple(key for _, key in places) if ordered else None)
        for stage in part.stages:
            relation = apply(stage, relation, context)
        return relation

    context = Context(keys, now, compiled)
    return compiled(query)


def named(relation: Relation) -> DataFrame:
    """The rows with the names that the query gives its columns; names may repeat."""
    columns = relation.scope.columns
    frame = relation.frame.orderBy(*relation.order) if relation.order else relation.frame
    return frame.select(*[c.key for c in columns]).toDF(*[c.name for c in columns])
