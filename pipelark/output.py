"""Results as text: table, CSV, JSON lines, JSON.

Rows are fetched partition by partition, so that a result need not fit into the
driver's memory (a table's columns are only as wide as its rows are, though, so
a table is held whole).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import Decimal
from typing import TextIO

from .engine import Result
from .functions.spans import spelled


def _digits(value: float) -> tuple[str, int]:
    """The shortest decimal digits of a positive number, and the exponent of the first of them."""
    exact = Decimal(repr(value))
    return "".join(map(str, exact.as_tuple().digits)).rstrip("0"), exact.adjusted()


def _spread(digits: str, exponent: int) -> str:
    """Digits without an exponent."""
    if exponent < 0:
        return f"0.{'0' * (-exponent - 1)}{digits}"
    whole, part = digits[: exponent + 1].ljust(exponent + 1, "0"), digits[exponent + 1 :]
    return f"{whole}.{part}" if part else whole


def _scientific(digits: str, exponent: int, places: int) -> str:
    mantissa = digits[0] + (f".{digits[1:]}" if len(digits) > 1 else "")
    return f"{mantissa}e{'-' if exponent < 0 else '+'}{abs(exponent):0{places}d}"


def number(value: float) -> str:
    """The shortest text that reads as the same number, with an exponent below 1e-4 and from 1e6 on."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    sign = "-" if math.copysign(1, value) < 0 else ""
    if value == 0:
        return f"{sign}0"
    digits, exponent = _digits(abs(value))
    return sign + (_spread(digits, exponent) if -4 <= exponent < 6 else _scientific(digits, exponent, 2))


def json_number(value: float) -> str:
    """As JSON writers do: without an exponent from 1e-6 up to 1e21."""
    if not math.isfinite(value):
        raise ValueError(f"JSON has no number for {number(value)}")
    sign = "-" if math.copysign(1, value) < 0 else ""
    if value == 0:
        return f"{sign}0"
    digits, exponent = _digits(abs(value))
    return sign + (_scientific(digits, exponent, 1 if abs(exponent) < 10 and exponent < 0 else 2) if exponent < -6 or exponent >= 21 else _spread(digits, exponent))


def moment(value: datetime) -> str:
    """RFC 3339 in UTC, without zeros at the end of the fraction."""
    fraction = f".{value.microsecond:06d}".rstrip("0") if value.microsecond else ""
    return f"{value.year:04d}-{value:%m-%dT%H:%M:%S}{fraction}Z"


def text(value) -> str:
    """A cell of a table or CSV record; null is empty."""
    match value:
        case None:
            return ""
        case bool():
            return "true" if value else "false"
        case float():
            return number(value)
        case datetime():
            return moment(value)
        case timedelta():
            return spelled(value)
    return str(value)


def _json_string(value: str) -> str:
    out = json.dumps(value, ensure_ascii=False)
    for sign in "<>&\u2028\u2029":
        out = out.replace(sign, f"\\u{ord(sign):04x}")
    return out


def _json(value) -> str:
    match value:
        case None:
            return "null"
        case bool() | int():
            return json.dumps(value)
        case float():
            return json_number(value)
    return _json_string(value if isinstance(value, str) else text(value))


def _rows(result: Result) -> Iterator[tuple]:
    yield from (tuple(row) for row in result.frame.toLocalIterator())


def _object(names: list[str], row: tuple) -> list[tuple[str, str]]:
    """Members by name in alphabetical order; of equal names the last stays."""
    return sorted((_json_string(k), _json(v)) for k, v in dict(zip(names, row)).items())


def _quoted(cell: str) -> str:
    needs = cell == r"\." or any(c in cell for c in ',"\r\n') or cell[:1].isspace()
    return '"{}"'.format(cell.replace('"', '""')) if needs else cell


def write_table(result: Result, out: TextIO) -> None:
    rows = [[c.name.upper() for c in result.columns], *([text(v) for v in row] for row in _rows(result))]
    widths = [max(map(len, column)) + 2 for column in zip(*rows)]
    for row in rows:
        out.write("".join(cell.ljust(width) for cell, width in zip(row[:-1], widths)) + row[-1] + "\n")


def write_csv(result: Result, out: TextIO) -> None:
    out.write(",".join(_quoted(c.name) for c in result.columns) + "\n")
    for row in _rows(result):
        out.write(",".join(_quoted(text(v)) for v in row) + "\n")


def write_jsonl(result: Result, out: TextIO) -> None:
    names = [c.name for c in result.columns]
    for row in _rows(result):
        out.write("{" + ",".join(f"{k}:{v}" for k, v in _object(names, row)) + "}\n")


def write_json(result: Result, out: TextIO) -> None:
    names, first = [c.name for c in result.columns], True
    out.write("[")
    for row in _rows(result):
        members = ",\n".join(f"    {k}: {v}" for k, v in _object(names, row))
        out.write(f"{'' if first else ','}\n  {{\n{members}\n  }}")
        first = False
    out.write("]\n" if first else "\n]\n")


FORMATS = {"table": write_table, "csv": write_csv, "jsonl": write_jsonl, "json": write_json}


def write(result: Result, form: str, out: TextIO) -> None:
    """All rows of a result in one of ``FORMATS``."""
    FORMATS[form](result, out)
