"""Time spans: their texts in queries, in data, and in output."""

from __future__ import annotations

import re
from datetime import timedelta
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of the units that durations in data are written with; nanoseconds are cut off.
UNITS = {"ns": Fraction(1, 1000), "us": 1, "µs": 1, "μs": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}

#: Queries know days and weeks besides.
QUERY_UNITS = {**UNITS, "d": 24 * UNITS["h"], "w": 7 * 24 * UNITS["h"]}

_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")
_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h))+$"


def microseconds(text: str) -> int | None:
    """A duration such as ``1h10m10s`` or ``-1.5h`` in whole microseconds; None if it isn't one."""
    if text in ("0", "+0", "-0"):
        return 0
    if not re.fullmatch(_PATTERN, text):
        return None
    total = sum(Fraction(number if not number.startswith(".") else f"0{number}") * UNITS[unit] for number, unit in _PART.findall(text))
    return -int(total) if text[0] == "-" else int(total)


def query_span(magnitude: int | float, unit: str) -> timedelta | None:
    """A span in a query: a number, a unit, and perhaps a duration behind it (``1d12h30m``); None if it isn't one."""
    number = Fraction(str(magnitude))
    if unit in ("ms", "us", "ns"):
        return timedelta(microseconds=int(number * UNITS[unit]))
    if unit[:1] not in ("d", "h", "m", "s", "w"):
        return None
    rest = microseconds(unit[1:]) if unit[1:] else 0
    if rest is None:
        return None
    return timedelta(microseconds=int(number * QUERY_UNITS[unit[0]]) + rest)


def parsed(text: Column) -> Column:
    """Durations in data as day-time intervals; what isn't one is null."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9.]+)([a-zµμ]+)"), F.lit(0))

    def size(part: Column) -> Column:
        number = F.regexp_extract(part, r"^[0-9.]+", 0)
        # try_cast knows neither "1." nor ".5"
        exact = F.concat(F.lit("0"), F.rtrim(number, F.lit("."))).try_cast("decimal(25,9)")
        unit = F.regexp_extract(part, r"[a-zµμ]+$", 0)
        scale = F.lit(None).cast("decimal(13,3)")
        for name, micros in UNITS.items():
            scale = F.when(unit == name, F.lit(f"{float(micros):.3f}").cast("decimal(13,3)")).otherwise(scale)
        return (exact * scale).cast("decimal(28,3)")

    total = F.aggregate(F.transform(parts, size), F.lit(0).cast("decimal(38,3)"), lambda a, b: (a + b).cast("decimal(38,3)"))
    whole = F.when(total < 0, F.ceil(total)).otherwise(F.floor(total)).cast("long")
    signed = F.when(text.startswith("-"), -whole).otherwise(whole)
    # An interval of whole seconds and one of the rest, as each argument is exact.
    seconds = (signed / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    zero = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    return F.when(text.rlike(_PATTERN), interval).when(text.isin("0", "+0", "-0"), zero)


def spelled(span: timedelta) -> str:
    """A span the way durations are printed: ``1h10m10s``, ``1.5s``, ``250ms``, ``0s``."""
    micros = (span.days * 86_400 + span.seconds) * 1_000_000 + span.microseconds
    sign, micros = ("-", -micros) if micros < 0 else ("", micros)
    if micros == 0:
        return "0s"

    def number(amount: int, unit: int) -> str:
        whole, rest = divmod(amount, unit)
        digits = len(str(unit)) - 1
        return f"{whole}.{rest:0{digits}d}".rstrip("0") if rest else str(whole)

    if micros < 1_000:
        return f"{sign}{micros}µs"
    if micros < 1_000_000:
        return f"{sign}{number(micros, 1_000)}ms"
    minutes, seconds = divmod(micros, 60_000_000)
    hours, minutes = divmod(minutes, 60)
    lead = f"{hours}h{minutes}m" if hours else f"{minutes}m" if minutes else ""
    return f"{sign}{lead}{number(seconds, 1_000_000)}s"
