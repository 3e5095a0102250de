"""URL filters: many wildcard rules at once, with a bit-parallel automaton.

All patterns lie one after another in a row of bits, one bit for each place in a
pattern.  For each character of a URL the row is shifted and masked (Shift-And);
a wildcard keeps its bit.  The row has as many 64-bit words as the patterns
need, and numpy advances a batch of URLs together.

In a pattern ``?`` stands for one character but ``/``, ``*`` for any run without
``/``, and ``**`` for any run.  Patterns match the whole canonical URL, which is
its host in small letters and its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import free, mapped, pieces
from .session import ready

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """What to do with a host, its subdomains and the paths that start like ``path``."""

    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def patterns(self) -> tuple[str, ...]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


class Automaton:
    """Patterns in one row of bits."""

    def __init__(self, patterns: list[str]):
        self.accepts, places, starts = [], [], []
        stay_any, stay_run, stay_char = [], [], []
        for pattern in patterns:
            starts.append(len(places))
            for part in re.findall(r"\*+|[^*]", pattern):
                if part[0] == "*":
                    # The place before the next character keeps its bit.
                    (stay_any if len(part) > 1 else stay_run).append(len(places))
                elif part == "?":
                    places.append(None)
                    stay_char.append(len(places))  # for the other bytes of the character
                else:
                    places.extend(part.encode())
            self.accepts.append(len(places))
            places.append(-1)  # past the last character: nothing leads on
        self.words = max(1, -(-len(places) // 64))
        self.start = self._row(starts)
        on = [[] for _ in range(256)]
        for at, place in enumerate(places):
            for c in range(256):
                if place == c or (place is None and c != 47 and not 128 <= c < 192):
                    on[c].append(at)
        self.leads = np.stack([self._row(x) for x in on])
        run = self._row(stay_run) | self._row(stay_any)
        self.stays = np.tile(run, (256, 1))
        self.stays[47] = self._row(stay_any)
        self.stays[128:192] |= self._row(stay_char)

    def _row(self, bits: list[int]) -> np.ndarray:
        row = np.zeros(self.words, dtype=np.uint64)
        for bit in bits:
            row[bit // 64] |= np.uint64(1 << bit % 64)
        return row

    def match(self, texts: list[bytes]) -> np.ndarray:
        """For each text and pattern whether the whole text matches.

        Longer texts come first, so that those still running are a prefix of the
        rows and no text is padded.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            running = int(np.searchsorted(-sizes, -at))  # texts longer than ``at``
            chars = flat[begin[:running] + at]
            now = state[:running]
            moved = now & self.leads[chars]
            carry = moved[:, :-1] >> top
            moved <<= one
            moved[:, 1:] |= carry
            state[:running] = moved | (now & self.stays[chars])
        out = np.zeros((len(texts), len(self.accepts)), dtype=bool)
        for k, bit in enumerate(self.accepts):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z small; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """From the host on up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def filter_urls(df: DataFrame, rules: list[Rule], blocked: list[str], url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` of every URL.

    The longest rule that fits decides; where none fits, the URL is blocked if
    one of the wildcard patterns ``blocked`` matches it, and allowed otherwise.
    Null URLs and those without ``://`` have an empty host and path; very long
    ones are matched whole.  All rows are kept and other columns pass through; those named like results are
    replaced; an empty table gives an empty result.
    """
    ready(df.sparkSession)
    named = [(rule, p) for rule in rules for p in rule.patterns()]
    automaton = Automaton([p for _, p in named] + list(blocked))
    # Rows of the match table by rule, the longest rule first.
    ranked = sorted({r: [i for i, (x, _) in enumerate(named) if x == r] for r in rules}.items(), key=lambda x: -len(x[0].name))
    own = {"host", "path", "rule", "verdict"}
    kept = [c for c in df.columns if c.lower() not in own]
    at = free(kept, "canonical")
    rows = df.select(*[df[f"`{c}`"] for c in kept], host_of(df[f"`{url}`"]).alias("host"), path_of(df[f"`{url}`"]).alias("path"))
    rows = rows.withColumn(at, F.concat("host", "path"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1):
                texts = [(t.as_py() or "").encode() for t in part.column(part.num_columns - 1)]
                hits = automaton.match(texts)
                rule = np.full(len(texts), None, dtype=object)
                verdict = np.where(hits[:, len(named) :].any(1), "block", "allow").astype(object)
                for r, columns in reversed(ranked):
                    fits = hits[:, columns].any(1)
                    rule[fits], verdict[fits] = r.name, r.action
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return mapped(rows, work, schema)
