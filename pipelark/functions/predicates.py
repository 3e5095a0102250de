"""Conditions as Spark columns.

In a query a comparison with null is false, so that its negation is true; in
Spark both are null.  Conditions without ``not`` may stay as Spark has them: a
filter drops null as it drops false, and ``and`` and ``or`` can't turn null into
true.  ``not`` is moved inward to the comparisons, where the null case is added.
All of that can be pushed down to scans, which a coalesce() could not.

Spark takes NaN for equal to itself and larger than all numbers.  Here it is as
IEEE 754 has it: a comparison with NaN is false, but for ``!=``, which is true.  The
test for NaN stands beside the comparison, which is still pushed down; a negation
isn't then, as the smallest and largest number of a block don't tell of its NaNs.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import syntax as S
from ..plans.types import Kind, check_comparison
from .scalars import Scalars

_SIGNS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "=~": lambda a, b: F.lower(a) == F.lower(b),
    # These three mind letter case.
    "contains": lambda a, b: a.contains(b),
    "startswith": lambda a, b: a.startswith(b),
    "endswith": lambda a, b: a.endswith(b),
}


def condition(node: S.Predicate, scalars: Scalars) -> Column:
    """A column that is true for the rows a condition holds for, and false or null for others."""
    return _lower(node, scalars, True)


def _lower(node: S.Predicate, scalars: Scalars, wanted: bool) -> Column:
    match node:
        case S.Not(inner):
            return _lower(inner, scalars, not wanted)
        case S.Both(left, right) | S.Either(left, right):
            a, b = _lower(left, scalars, wanted), _lower(right, scalars, wanted)
            return a & b if isinstance(node, S.Both) == wanted else a | b
        case S.NullTest(kind, field):
            return _null_test(kind, field, scalars, wanted)
        case S.Compare(sign, left, right):
            (a, left_kind), (b, right_kind) = scalars.lower(left), scalars.lower(right)
            check_comparison(sign, left_kind, right_kind)
            nullable = [c for c, n in ((a, left), (b, right)) if not isinstance(n, S.Literal | S.Ago)]
            # Literals are numbers, and whole numbers have no NaN.
            a_real, b_real = (k is Kind.REAL and not isinstance(n, S.Literal) for k, n in ((left_kind, left), (right_kind, right)))
            return _settle(_ieee(sign, a, b, a_real, b_real), nullable, wanted)
        case S.Among(field, values, negated):
            a, kind = scalars.lower(field)
            lowered = [scalars.lower(v) for v in values]
            for _, value_kind in lowered:
                check_comparison("==", kind, value_kind)
            among = a.isin([v for v, _ in lowered])
            return _settle(~among if negated else among, [a], wanted)
        case S.Between(field, low, high):
            (a, kind), (b, low_kind), (c, high_kind) = scalars.lower(field), scalars.lower(low), scalars.lower(high)
            check_comparison("<=", kind, low_kind)
            check_comparison("<=", kind, high_kind)
            return _settle(a.between(b, c), [a], wanted)
    raise TypeError(node)


def _ieee(sign: str, a: Column, b: Column, a_real: bool, b_real: bool) -> Column:
    """A comparison in which NaN is neither equal to, less nor more than anything."""
    test = _SIGNS[sign](a, b)
    # What Spark holds true of NaN: that it equals itself, and that it is the largest number.
    if sign in ("<", "<=") and b_real:
        return test & ~F.isnan(b)
    if sign in (">", ">=") and a_real:
        return test & ~F.isnan(a)
    if sign == "==" and a_real and b_real:
        return test & ~F.isnan(a)
    if sign == "!=" and a_real and b_real:
        return test | (F.isnan(a) & F.isnan(b))
    return test


def _settle(test: Column, nullable: list[Column], wanted: bool) -> Column:
    """A test or its negation, which also holds if an operand is null."""
    return test if wanted else reduce(or_, [c.isNull() for c in nullable], ~test)


def _null_test(kind: str, field: S.Field, scalars: Scalars, wanted: bool) -> Column:
    column, column_kind = scalars.lower(field)
    if kind == "isempty" and column_kind is Kind.STRING:
        return column.isNull() | (column == "") if wanted else column.isNotNull() & (column != "")
    return column.isNotNull() if (kind == "isnotnull") == wanted else column.isNull()
