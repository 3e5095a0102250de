"""Aggregates as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryTypeError
from ..plans import syntax as S
from ..plans.scope import Scope
from ..plans.types import NUMBERS, WHOLE, Kind

_ORDERED = NUMBERS | {Kind.DATETIME, Kind.TIMESPAN}


def name(aggregate: S.Aggregate) -> str:
    """The alias, or what an aggregate is called without one."""
    return aggregate.alias or (f"{aggregate.function}_{aggregate.field.name}" if aggregate.field else "count_")


def lower(aggregate: S.Aggregate, scope: Scope) -> tuple[Column, Kind]:
    """Nulls aren't counted in; a sum of nothing is 0, and avg, min and max of nothing are null.

    min and max pass over NaN, unless there is nothing else.
    """
    if aggregate.function == "count":
        return F.count("*"), Kind.LONG
    found = scope.find(aggregate.field)
    column, kind = F.col(found.key), found.kind
    allowed = {"sum": NUMBERS, "avg": NUMBERS, "min": _ORDERED, "max": _ORDERED, "dcount": frozenset(Kind)}[aggregate.function]
    if kind not in allowed:
        raise QueryTypeError(f"{aggregate.function}() not applicable to {kind.value} column {aggregate.field}")
    match aggregate.function:
        case "sum":
            zero = F.lit(0).cast("long") if kind in WHOLE else F.lit(0.0)
            return F.coalesce(F.sum(column), zero), Kind.LONG if kind in WHOLE else kind
        case "avg":
            return F.avg(column), Kind.REAL
        case "min":
            return F.min(column), kind
        case "max":
            if kind is Kind.REAL:  # Spark has NaN as the largest number
                return F.coalesce(F.max(F.when(~F.isnan(column), column)), F.max(column)), kind
            return F.max(column), kind
    return F.count_distinct(column), Kind.LONG
