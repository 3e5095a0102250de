"""Token counts of byte-level vocabularies at every prefix of a text.

The counts come from a prefix table, not from an encoding: the last token of
each prefix is unique, so a prefix has one token more than the prefix before its
last token.  With the counts of all prefixes, how many tokens a text has, where
to cut it for a budget and how far a cut text is over it are look-ups.

A text is first cut at its special strings and then into the tokenizer's runs
(contractions, letters, digits, other signs, white space).  Joins don't cross
these, so that the table of a text is made of tables of runs, which are
remembered.  A cut inside a run can change the runs next to it; ``_unit`` says
where, and the counts there are those of the text that really ends at the cut.
"""

from __future__ import annotations

import array
import json
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import extended
from .merges import Memo, MergeVocabulary
from .session import ready

#: The runs of byte-level vocabularies, a fixed value of the public format.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run with the white space before it: the largest part whose runs don't depend on its neighbours.
UNITS = r"(?:\s*[^\S ])?'(?:[stmd]|re|ve|ll)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"

#: What the runs count as white space.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Counts for one ``tokenizers`` file (byte-level BPE without normaliser), given as bytes."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("only plain byte-level vocabularies can be counted")
        if model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("only vocabularies that follow their joins can be counted")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only special strings that are matched as they are can be counted")
        value = {letter: chr(b) for b, letter in enumerate(byte_letters())}
        added = {t["content"] for t in spec["added_tokens"]}
        pieces = {i: "".join(value[c] for c in piece) for piece, i in model["vocab"].items() if piece not in added}
        ids = model["vocab"]
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.vocabulary = MergeVocabulary(pieces, lambda a, b: merges.get((a, b)))
        self.runs, self.units = regex.compile(RUNS).findall, regex.compile(UNITS).findall
        # Of special strings that start at the same place, the longest is taken.
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.memo = Memo(self._unit)

    def _bytes(self, run: str) -> list[int]:
        """Counts of the prefixes of one run, at its characters; the empty prefix included."""
        spelled = run.encode("utf-8", "surrogatepass")
        counts = self.vocabulary.counts(spelled.decode("latin-1"))
        if len(spelled) == len(run):
            return counts
        return [counts[at] for at in (0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in run))]

    def _unit(self, unit: str) -> bytes:
        """What each character of a unit adds to the count, as 16-bit numbers.

        * A cut in white space ends a text in one run of white space.  Before
          another run, that run's last space belongs to the run, or its last
          other sign is a run of its own.
        * A cut in a contraction of three signs leaves its first sign alone.
        """
        first, second = unit[0], unit[1:2]
        if first != "'" and (first not in WHITE or (first == " " and second and second not in WHITE)):
            counts = self._bytes(unit)  # one run, with a space before it or none
        else:
            white = unit[: next((i for i, c in enumerate(unit) if c not in WHITE), len(unit))]
            counts = self._bytes(white)
            if len(white) < len(unit):
                *spaces, run = self.runs(unit)
                inner = self._bytes(run)
                if run in ("'re", "'ve", "'ll"):
                    inner[2] = 2
                base = sum(self._bytes(w)[-1] for w in spaces)
                counts += [base + n for n in inner[2 if run[0] == " " else 1 :]]
        return array.array("h", map(int.__sub__, counts[1:], counts)).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text without special strings, the empty one left out."""
        steps = b"".join(map(self.memo.__getitem__, self.units(text)))
        return np.frombuffer(steps, dtype=np.int16).cumsum(dtype=np.int64)

    def prefixes(self, text: str) -> np.ndarray:
        """The number of tokens of every prefix, by characters; entry 0 is the empty prefix."""
        parts, at, total = [np.zeros(1, dtype=np.int64)], 0, 0
        for match in self.special.finditer(text) if self.special else ():
            # Until its last character the special string is ordinary text.
            begun = self._plain(text[at : match.end() - 1])
            whole = self._plain(text[at : match.start()])
            n = int(whole[-1]) if len(whole) else 0
            parts += [total + whole, total + begun[len(whole) :], np.array([total + n + 1])]
            at, total = match.end(), total + n + 1
        parts.append(total + self._plain(text[at:]))
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def counter(file: bytes) -> PrefixCounter:
    """The counter of a file, built once in a worker."""
    return PrefixCounter(file)


def fits(counts: np.ndarray, budget: int) -> int:
    """The most characters from the start that have ``budget`` tokens at most."""
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_counts(df: DataFrame, tokenizer_path: str, text: str = "text", counts: str = "prefix_counts") -> DataFrame:
    """``df`` with the whole table of each text: the tokens of each prefix, from the empty one on.

    Null and empty texts have the empty prefix only; the table of a very long text
    is as long as the text.  All rows are kept, repeated ones and those with nulls
    elsewhere included; other columns pass through, one named like the result is
    replaced; an empty table gives an empty result.
    """
    return _tables(df, tokenizer_path, text, [T.StructField(counts, T.ArrayType(T.IntegerType()))], lambda table: [table.tolist()])


def token_budget(df: DataFrame, tokenizer_path: str, budget: int = 512, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` of each text and ``fit_chars``, how many of its characters fit into ``budget``.

    Both are read from the prefix table.  Null and empty texts have no tokens; very
    long ones are counted whole.  All rows are kept, repeated ones and those with nulls elsewhere included;
    other columns pass through, those named like results are replaced; an empty
    table gives an empty result.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())]
    return _tables(df, tokenizer_path, text, fields, lambda table: [int(table[-1]), fits(table, budget)])


def _tables(df: DataFrame, path: str, text: str, fields: list[T.StructField], read) -> DataFrame:
    with open(path, "rb") as f:  # a vocabulary: some MB whatever the corpus
        file = ready(df.sparkSession).sparkContext.broadcast(f.read())

    def make():
        made = counter(file.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [read(made.prefixes(t.as_py() or "")) for t in texts]
            kinds = [pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.int64() for f in fields]
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return work

    return extended(df, text, fields, make)
