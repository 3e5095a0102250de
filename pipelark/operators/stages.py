"""Each stage as a DataFrame operation.

A stage takes a relation, which is a DataFrame together with the names it can be
addressed by, and returns another.  Nothing is run: filters and columns get to the
scans, and joins and shuffles get their strategies, by Spark's optimizer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryTypeError
from ..functions import aggregates
from ..functions.predicates import condition
from ..functions.scalars import Scalars, has_field
from ..plans import syntax as S
from ..plans.scope import ColumnInfo, Keys, Scope
from ..plans.types import NUMBERS, WHOLE, Kind


#: What a limit of Spark can be.
MOST_ROWS = 2**31 - 1


@dataclass(frozen=True)
class Relation:
    """Rows, and the columns that a query sees in them.

    ``order`` has the columns that tell the rows' order, the first one first, or is
    None where rows have no order.
    """

    frame: DataFrame
    scope: Scope
    order: tuple[str, ...] | None = None

    def columns(self) -> list[str]:
        """The columns that tell the order."""
        return list(self.order or ())


@dataclass(frozen=True)
class Context:
    """What all stages of a query share: column names in use, one clock reading, and how to make sub-queries."""

    keys: Keys
    now: datetime
    compile: Callable[[S.Query], Relation]


def where(stage: S.Where, given: Relation, context: Context) -> Relation:
    return Relation(given.frame.filter(condition(stage.predicate, Scalars(given.scope, context.now))), given.scope, given.order)


def project(stage: S.Project, given: Relation, context: Context) -> Relation:
    """Listed columns only; a renamed column keeps its table, a computed one has none."""
    scalars, selected, columns = Scalars(given.scope, context.now), [], []
    for item in stage.items:
        if item.alias and not has_field(item.value):
            raise QueryTypeError(f'project: "{item.alias}": a new column must be computed from one that is there')
        value, kind = scalars.lower(item.value)
        key, origin, name = context.keys.new(), None, item.alias
        if isinstance(item.value, S.Field):
            source = given.scope.find(item.value)
            origin, name = source.origin, name or source.name
        selected.append(value.alias(key))
        columns.append(ColumnInfo(name, origin, kind, key))
    return Relation(given.frame.select(*selected, *given.columns()), Scope(tuple(columns)), given.order)


def summarize(stage: S.Summarize, given: Relation, context: Context) -> Relation:
    """Aggregates first, then the columns grouped by; null is a group of its own.

    Without groups there is one row, or none if nothing comes in.  Groups are in the
    order of their first rows.
    """
    made, columns = [], []
    for aggregate in stage.aggregates:
        value, kind = aggregates.lower(aggregate, given.scope)
        key = context.keys.new()
        made.append(value.alias(key))
        columns.append(ColumnInfo(aggregates.name(aggregate), None, kind, key))
    groups = [given.scope.find(field) for field in stage.by]
    order = None if given.order is None else (context.keys.new(),)
    if order:
        made.append(F.min(F.struct(*given.order)).alias(order[0]))
    if groups:
        frame = given.frame.groupBy(*dict.fromkeys(g.key for g in groups)).agg(*made)
    else:
        rows = context.keys.new()
        frame = given.frame.agg(F.count("*").alias(rows), *made).filter(F.col(rows) > 0)
    again = [context.keys.new() for _ in groups]
    frame = frame.select(*[c.key for c in columns], *[F.col(g.key).alias(k) for g, k in zip(groups, again)], *(order or ()))
    columns += [ColumnInfo(g.name, g.origin, g.kind, k) for g, k in zip(groups, again)]
    return Relation(frame, Scope(tuple(columns)), order)


def join(stage: S.Join, left: Relation, context: Context) -> Relation:
    """Inner equi-join: left columns, then right ones; null keys equal each other.  Rows are in the order of the left, then the right ones."""
    right = context.compile(stage.query)
    tests, twins = [], set()
    for key in stage.keys:
        a, b = left.scope.find(S.Field(key.left)), right.scope.find(S.Field(key.right))
        if a.kind.family != b.kind.family:
            raise QueryTypeError(f'join: cannot compare {a.kind.family} column "{key.left}" with {b.kind.family} column "{key.right}"')
        one, two = F.col(a.key), F.col(b.key)
        if a.kind is not b.kind and a.kind in NUMBERS:
            wide = "long" if {a.kind, b.kind} <= WHOLE else "double"
            one, two = one.cast(wide), two.cast(wide)
        tests.append(one.eqNullSafe(two))
        if a.name == b.name:
            twins.add(b.key)
    order = None if left.order is None else (*left.order, *right.columns())
    return Relation(left.frame.join(right.frame, reduce(and_, tests), "inner"), left.scope.joined(right.scope, twins), order)


def sort(stage: S.Sort, given: Relation, context: Context) -> Relation:
    """By columns, nulls last in either direction; text by its bytes.  Where rows have an order, equal ones keep it."""
    orders = []
    for order in stage.orders:
        column = F.col(given.scope.find(order.field).key)
        orders.append(column.desc_nulls_last() if order.descending else column.asc_nulls_last())
    if given.order is None:
        return Relation(given.frame.orderBy(*orders), given.scope)
    # Numbers rise from partition to partition, which a sort leaves in order.
    place = context.keys.new()
    ranked = given.frame.orderBy(*orders, *given.order).drop(*given.order).withColumn(place, F.monotonically_increasing_id())
    return Relation(ranked, given.scope, (place,))


def take(stage: S.Take, given: Relation, context: Context) -> Relation:
    """Some rows, or the first ones where rows have an order."""
    if stage.rows > MOST_ROWS:
        raise QueryTypeError(f"take: at most {MOST_ROWS} rows are possible")
    frame = given.frame.orderBy(*given.order) if given.order else given.frame
    return Relation(frame.limit(stage.rows), given.scope, given.order)


def count(stage: S.Count, given: Relation, context: Context) -> Relation:
    """One row, also of nothing; the column is ``count`` and answers to ``count_`` as well, since ``count`` is reserved."""
    key = context.keys.new()
    return Relation(given.frame.agg(F.count("*").alias(key)), Scope((ColumnInfo("count", None, Kind.LONG, key, also="count_"),)))


OPERATORS = {S.Where: where, S.Project: project, S.Summarize: summarize, S.Join: join, S.Sort: sort, S.Take: take, S.Count: count}


def apply(stage: S.Stage, given: Relation, context: Context) -> Relation:
    return OPERATORS[type(stage)](stage, given, context)
