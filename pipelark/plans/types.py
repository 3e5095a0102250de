"""Types of columns, and which of them fit together."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

from ..errors import QueryTypeError


class Kind(Enum):
    """A column type; values are its names in schema files (``long`` only comes from computation)."""

    INT = "int"
    LONG = "long"
    REAL = "real"
    STRING = "string"
    BOOL = "bool"
    DATETIME = "datetime"
    TIMESPAN = "timespan"
    DYNAMIC = "dynamic"

    @property
    def family(self) -> str:
        """Numbers may be mixed; all other types only compare with themselves."""
        return "numeric" if self in NUMBERS else self.value


NUMBERS = frozenset([Kind.INT, Kind.LONG, Kind.REAL])
WHOLE = frozenset([Kind.INT, Kind.LONG])

#: The types that a schema file may name.
DECLARED = {k.value: k for k in Kind if k is not Kind.LONG}

SPARK = {
    Kind.INT: T.IntegerType(),
    Kind.LONG: T.LongType(),
    Kind.REAL: T.DoubleType(),
    Kind.STRING: T.StringType(),
    Kind.BOOL: T.BooleanType(),
    Kind.DATETIME: T.TimestampNTZType(),
    Kind.TIMESPAN: T.DayTimeIntervalType(),
    Kind.DYNAMIC: T.StringType(),
}


def arithmetic(sign: str, left: Kind, right: Kind) -> Kind:
    """The type of ``left sign right``."""
    if left in WHOLE and right in WHOLE:
        return Kind.LONG
    if left in NUMBERS and right in NUMBERS:
        return Kind.REAL
    match left, sign, right:
        case Kind.DATETIME, "-", Kind.DATETIME:
            return Kind.TIMESPAN
        case (Kind.DATETIME | Kind.TIMESPAN), ("+" | "-"), Kind.TIMESPAN:
            return left
        case Kind.TIMESPAN, ("*" | "/"), (Kind.INT | Kind.LONG | Kind.REAL):
            return left
    raise QueryTypeError(f"no type rule for {left.value} {sign} {right.value}")


def check_comparison(sign: str, left: Kind, right: Kind) -> None:
    """Whether two values may be compared with a sign."""
    pair = {left.family, right.family}
    if len(pair) > 1 and pair != {"dynamic", "string"}:
        raise QueryTypeError(f"comparison type mismatch: cannot compare {left.family} with {right.family}")
    if pair & {"bool", "dynamic"}:
        allowed = {"==", "!="}
    elif pair == {"string"}:
        return
    else:
        allowed = {"==", "!=", "<", "<=", ">", ">="}
    if sign not in allowed:
        raise QueryTypeError(f"operator '{sign}' not applicable to {left.family} columns")
