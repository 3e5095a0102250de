"""Random conditions over rows with nulls against the language's two-valued logic, spelled out in Python."""

import operator
import random

import pytest

from pipelark import engine
from pipelark.sources.catalog import Catalog, Entry

ROWS = [(n, i, x, s, b) for n, (i, x, s, b) in enumerate((i, x, s, b) for i in (None, 1, 5) for x in (None, -0.5, 5.0) for s in (None, "", "Ab", "abc") for b in (None, True, False))]
SIGNS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
TEXTS = {"contains": lambda a, b: b in a, "startswith": str.startswith, "endswith": str.endswith, "=~": lambda a, b: a.lower() == b.lower()}


def value(rng, row_of):
    """A number as text, and how to find it in a row; null if a field in it is null."""
    kind = rng.randrange(5)
    if kind < 2:
        name = "ix"[kind]
        return name, lambda r: r[row_of[name]]
    if kind == 2:
        n = rng.choice([0, 1, 5])
        return str(n), lambda r: n
    (a, f), (b, g) = value(rng, row_of), value(rng, row_of)
    sign = rng.choice("+-*")
    act = {"+": operator.add, "-": operator.sub, "*": operator.mul}[sign]
    return f"({a} {sign} {b})", lambda r: None if f(r) is None or g(r) is None else act(f(r), g(r))


def condition(rng, depth=0):
    row_of = {"i": 1, "x": 2, "s": 3, "b": 4}
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind == 0:
        (a, f), (b, g) = value(rng, row_of), value(rng, row_of)
        sign = rng.choice(list(SIGNS))
        return f"{a} {sign} {b}", lambda r: f(r) is not None and g(r) is not None and SIGNS[sign](f(r), g(r))
    if kind == 1:
        sign, text = rng.choice([*SIGNS, *TEXTS]), rng.choice(["", "ab", "b", "Abc"])
        act = SIGNS.get(sign) or TEXTS[sign]
        return f's {sign} "{text}"', lambda r: r[3] is not None and act(r[3], text)
    if kind == 2:
        name, values = rng.choice([("i", (1, 2)), ("x", (5, 7)), ("s", ("", "Ab"))])
        negated = rng.random() < 0.5
        spelled = ", ".join(f'"{v}"' if isinstance(v, str) else str(v) for v in values)
        return f"{name} {'!' * negated}in ({spelled})", lambda r: r[row_of[name]] is not None and (r[row_of[name]] in values) != negated
    if kind == 3:
        return "x between (0 .. 5)", lambda r: r[2] is not None and 0 <= r[2] <= 5
    if kind == 4:
        name, test = rng.choice("ixsb"), rng.choice(["isnull", "isnotnull", "isempty"])
        if test == "isempty":
            return f"isempty({name})", lambda r: r[row_of[name]] is None or r[row_of[name]] == "" and name == "s"
        return f"{test}({name})", lambda r: (r[row_of[name]] is None) == (test == "isnull")
    if kind == 5:
        sign, truth = rng.choice(["==", "!="]), rng.random() < 0.5
        return f"b {sign} {str(truth).lower()}", lambda r: r[4] is not None and SIGNS[sign](r[4], truth)
    a, f = condition(rng, depth + 1)
    if kind == 6:
        return f"not ({a})", lambda r: not f(r)
    b, g = condition(rng, depth + 1)
    word = "and" if kind == 7 else "or"
    return f"({a} {word} {b})", (lambda r: f(r) and g(r)) if kind == 7 else (lambda r: f(r) or g(r))


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame(ROWS, "n int, i int, x double, s string, b boolean").coalesce(1).cache()
    frame.count()
    return Catalog([Entry("t", "dataframe", frame=frame)])


@pytest.mark.parametrize("seed", range(6))
def test_conditions(spark, rows, seed):
    rng = random.Random(seed)
    for _ in range(12):
        text, holds = condition(rng)
        found = {r.n for r in engine.execute(spark, f"t (*) | where {text} | project n", rows).collect()}
        assert found == {r[0] for r in ROWS if holds(r)}, text
