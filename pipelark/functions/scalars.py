"""Values: fields, literals and arithmetic as Spark columns."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryTypeError
from ..plans import syntax as S
from ..plans.scope import Scope
from ..plans.types import Kind, arithmetic


def instant(value: datetime) -> Column:
    """A point in time without zone, as a literal that scans can be pruned by."""
    return F.expr(f"TIMESTAMP_NTZ'{value:%Y-%m-%d %H:%M:%S.%f}'" if value.year >= 1000 else f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'")


def literal(value) -> tuple[Column, Kind]:
    match value:
        case bool():
            return F.lit(value), Kind.BOOL
        case int():
            return F.lit(value).cast("long"), Kind.LONG
        case float():
            return F.lit(value), Kind.REAL
        case str():
            return F.lit(value), Kind.STRING
        case datetime():
            return instant(value), Kind.DATETIME
    raise TypeError(value)


def has_field(node: S.Scalar) -> bool:
    match node:
        case S.Field():
            return True
        case S.Arithmetic(_, left, right):
            return has_field(left) or has_field(right)
        case S.Minus(inner):
            return has_field(inner)
    return False


class Scalars:
    """Lowers values in a scope; ``now`` is the one clock reading of the query."""

    def __init__(self, scope: Scope, now: datetime):
        self.scope, self.now = scope, now

    def lower(self, node: S.Scalar) -> tuple[Column, Kind]:
        match node:
            case S.Field():
                column = self.scope.find(node)
                return F.col(column.key), column.kind
            case S.Literal(value):
                return literal(value)
            case S.Ago(span):
                return instant(ago(self.now, span)), Kind.DATETIME
            case S.Minus(inner):
                column, kind = self.lower(inner)
                if kind not in (Kind.INT, Kind.LONG, Kind.REAL, Kind.TIMESPAN):
                    raise QueryTypeError(f"{kind.value} values have no negative")
                return (-column.cast("long"), Kind.LONG) if kind is Kind.INT else (-column, kind)
            case S.Arithmetic(sign, left, right):
                a, left_kind = self.lower(left)
                b, right_kind = self.lower(right)
                return _arithmetic(sign, a, left_kind, b, right_kind)
        raise TypeError(node)


def ago(now: datetime, span: timedelta) -> datetime:
    """``now`` less a span, the earliest time there is if that is earlier still."""
    try:
        return now - span
    except OverflowError:
        return datetime.min


def _arithmetic(sign: str, a: Column, left: Kind, b: Column, right: Kind) -> tuple[Column, Kind]:
    kind = arithmetic(sign, left, right)
    if kind is Kind.LONG:
        a, b = a.cast("long"), b.cast("long")
        if sign == "/":  # truncates toward zero; dividing by zero is an error, as for all types
            return F.call_function("div", a, b), kind
    elif kind is Kind.REAL:
        a, b = a.cast("double"), b.cast("double")
    made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[sign]()
    return made, kind
