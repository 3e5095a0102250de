"""Which columns a stage can name.

Names may repeat after a join, and may be qualified by the table that a column
comes from.  Neither is possible with DataFrame columns, so that every column
has a name of its own inside a query (``key``); the names of the query are given
back at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import count

from ..errors import QueryTypeError
from .syntax import Field
from .types import Kind


@dataclass(frozen=True)
class ColumnInfo:
    """A column: its name, the table it comes from (None if computed), its type, and its DataFrame name.

    ``also`` is another name that it answers to.  A ``twin`` is the right copy of a
    join key of the same name, whose left copy is meant where both would be.
    """

    name: str
    origin: str | None
    kind: Kind
    key: str
    also: str | None = None
    twin: bool = False

    def answers(self, field: Field) -> bool:
        return field.name in (self.name, self.also) and field.table in (None, self.origin)


@dataclass(frozen=True)
class Scope:
    columns: tuple[ColumnInfo, ...]

    def find(self, field: Field) -> ColumnInfo:
        """The one column that a field means; raises :class:`QueryTypeError` if there is none or more."""
        found = [c for c in self.columns if c.answers(field)]
        if len(found) > 1:
            found = [c for c in found if not c.twin]
        if not found:
            raise QueryTypeError(f"column {field} not found")
        if len(found) > 1:
            raise QueryTypeError(f"ambiguous column {field}; qualify with table name")
        return found[0]

    def joined(self, right: "Scope", twins: set[str]) -> "Scope":
        """Left then right columns; those of ``right`` whose keys are ``twins`` give way to their left copies."""
        return Scope(self.columns + tuple(replace(c, twin=c.twin or c.key in twins) for c in right.columns))


class Keys:
    """Names for the columns of one query."""

    def __init__(self):
        self._numbers = count()

    def new(self) -> str:
        return f"c{next(self._numbers)}"
