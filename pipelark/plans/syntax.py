"""The parts of a query."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta


@dataclass(frozen=True)
class Field:
    """A column by name, or by table and name."""

    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f'"{self.table}"."{self.name}"' if self.table else f'"{self.name}"'


# Scalars


@dataclass(frozen=True)
class Literal:
    """An int, float, str, bool or datetime."""

    value: int | float | str | bool | datetime


@dataclass(frozen=True)
class Ago:
    span: timedelta


@dataclass(frozen=True)
class Arithmetic:
    sign: str
    left: "Scalar"
    right: "Scalar"


@dataclass(frozen=True)
class Minus:
    inner: "Scalar"


Scalar = Field | Literal | Ago | Arithmetic | Minus

# Predicates


@dataclass(frozen=True)
class Compare:
    sign: str
    left: Scalar
    right: Scalar


@dataclass(frozen=True)
class Among:
    field: Field
    values: tuple[Literal | Ago, ...]
    negated: bool


@dataclass(frozen=True)
class Between:
    field: Field
    low: Literal | Ago
    high: Literal | Ago


@dataclass(frozen=True)
class NullTest:
    """``kind`` is isnull, isnotnull or isempty."""

    kind: str
    field: Field


@dataclass(frozen=True)
class Not:
    inner: "Predicate"


@dataclass(frozen=True)
class Both:
    left: "Predicate"
    right: "Predicate"


@dataclass(frozen=True)
class Either:
    left: "Predicate"
    right: "Predicate"


Predicate = Compare | Among | Between | NullTest | Not | Both | Either

# Stages


@dataclass(frozen=True)
class Where:
    predicate: Predicate


@dataclass(frozen=True)
class Item:
    alias: str | None
    value: Scalar


@dataclass(frozen=True)
class Project:
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Aggregate:
    """``function`` is count, sum, avg, min, max or dcount; only count has no field."""

    alias: str | None
    function: str
    field: Field | None


@dataclass(frozen=True)
class Summarize:
    aggregates: tuple[Aggregate, ...]
    by: tuple[Field, ...]


@dataclass(frozen=True)
class Key:
    """Columns of the left and the right side that are to be equal."""

    left: str
    right: str


@dataclass(frozen=True)
class Join:
    query: "Query"
    keys: tuple[Key, ...]


@dataclass(frozen=True)
class Order:
    field: Field
    descending: bool


@dataclass(frozen=True)
class Sort:
    orders: tuple[Order, ...]


@dataclass(frozen=True)
class Take:
    rows: int


@dataclass(frozen=True)
class Count:
    pass


Stage = Where | Project | Summarize | Join | Sort | Take | Count

# Sources


@dataclass(frozen=True)
class Everything:
    pass


@dataclass(frozen=True)
class Last:
    span: timedelta


@dataclass(frozen=True)
class Range:
    """Both ends belong to it."""

    start: datetime
    end: datetime


@dataclass(frozen=True)
class Source:
    table: str
    window: Everything | Last | Range


@dataclass(frozen=True)
class Query:
    source: Source
    stages: tuple[Stage, ...]

    def tables(self) -> set[str]:
        """Names of all tables that the query reads."""
        joined = [s.query.tables() for s in self.stages if isinstance(s, Join)]
        return {self.source.table}.union(*joined)
