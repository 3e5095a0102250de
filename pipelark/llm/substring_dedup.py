"""Substring deduplication by sliding sentence spans.

Every run of consecutive sentences is hashed, from each sentence the shortest
one that has at least two sentences and twenty words.  Runs are joined by hash over
all documents; of equal runs the first stays (smallest document, then smallest
place), and sentences that lie in any other one are removed.  So a passage that
two documents share goes from the second, and one document's own repeats go too.

Sentences end at ``.``, ``!`` or ``?`` before white space, and at line ends.  Clauses
(``,``, ``;``, ``:``) count as sentences of their own, and long ones are cut at places
that their words choose: otherwise a long sentence, or one that begins before a
shared passage, would hide it.  White space and letter case don't count in
comparisons.  Scripts that are written without spaces have a word for each
character, and their signs end sentences and clauses without white space behind.

Of every ``WINDOW`` places in a clause (not next to its ends) the one whose two
last words have the least hash is a cut.  So the cuts in a passage, but for those near its
ends, are the same whatever stands around it.  One word again and again has no
such place; it is cut every ``LONG`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import first_seen
from .batches import free, mapped, pieces
from .session import ready, settled

LEAST_SENTENCES, LEAST_WORDS, LONG = 2, 20, 24

#: Places of which one is a cut, and the seed of their hashes (with it the tests' clauses of few words again and again stay whole).
WINDOW, SEED = 16, 5

_ENDS = re.compile(r"(?<=[.!?,;:])\s+|\s*\n\s*")
_WORDS = re.compile(r"\S+")

#: Thai, Lao, Burmese, Khmer, kana and Han; with them other ends and words hold.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_is_unspaced = re.compile(f"[{_UNSPACED}]").search
_UNSPACED_ENDS = re.compile(_ENDS.pattern + r"|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])\s*")
_UNSPACED_WORDS = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")


def _cuts(words: list[str]) -> list[int]:
    """Numbers of words before each cut of a clause."""
    hashes = [xxhash.xxh3_64_intdigest(f"{a} {b}", SEED) for a, b in zip(words[:-3], words[1:-2])]
    found, best = [], -1
    for end in range(WINDOW - 1, len(hashes)):
        start = end - WINDOW + 1
        # The last one of the least hashes from ``start`` to ``end``.
        if best < start:
            best = start
            for i in range(start + 1, end + 1):
                if hashes[i] <= hashes[best]:
                    best = i
        elif hashes[end] <= hashes[best]:
            best = end
        # Equal neighbours: one word again and again.
        if best > start and hashes[best] == hashes[best - 1]:
            continue
        if not found or found[-1] != best + 2:
            found.append(best + 2)
    out, before = [], 0
    for cut in [*found, len(words)]:
        out += [*range(before + LONG, cut, LONG), cut]
        before = cut
    return out[:-1]


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, compared text, words) of each sentence; the white space between is left out."""
    found = []
    unspaced = _is_unspaced(text) is not None
    ends, of_words = (_UNSPACED_ENDS, _UNSPACED_WORDS) if unspaced else (_ENDS, _WORDS)

    def add(start: int, end: int) -> None:
        words = [m[0].lower() for m in of_words.finditer(text, start, end)] if unspaced else text[start:end].lower().split()
        if len(words) - 3 >= WINDOW or len(words) > LONG:
            places = [m.span() for m in of_words.finditer(text, start, end)]
            cuts = _cuts(words)
            for a, b in zip([0, *cuts], [*cuts, len(words)]):
                found.append((places[a][0], places[b - 1][1], " ".join(words[a:b]), b - a))
        elif words:
            found.append((start, end, " ".join(words), len(words)))

    at = 0
    for gap in ends.finditer(text):
        add(at, gap.start())
        at = gap.end()
    add(at, len(text))
    return found


def run_sizes(words: list[int], least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> list[int]:
    """How many sentences the shortest run from each sentence on has, up to the last one from which there is a run."""
    sizes, end, held = [], 0, 0
    for at in range(len(words)):
        while end < len(words) and (held < least_words or end - at < least_sentences):
            held += words[end]
            end += 1
        if held < least_words or end - at < least_sentences:
            break
        sizes.append(end - at)
        held -= words[at]
    return sizes


def spans(text: str, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """Two hashes of the run from each sentence on, and the number of sentences."""
    found = sentences(text)
    digests = [xxhash.xxh3_128_digest(s[2]) for s in found]
    sizes = run_sizes([s[3] for s in found], least_sentences, least_words)
    both = b"".join(xxhash.xxh3_128_digest(b"".join(digests[at : at + n])) for at, n in enumerate(sizes))
    halves = np.frombuffer(both, dtype=">i8").reshape(-1, 2).astype(np.int64)
    return halves[:, 0], halves[:, 1], len(found)


def _hashed(rows: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """``doc``, ``version``, the number of sentences and the hashes of all runs (``all_h1``, ``all_h2``); ``rows`` has doc, version and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                each = [spans(t.as_py() or "", least_sentences, least_words) for t in part.column(2)]
                ends = pa.array(np.cumsum([0, *(len(x[0]) for x in each)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in each]))) for i in range(2)]
                n = pa.array([x[2] for x in each], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, *lists], names=["doc", "version", "n", "all_h1", "all_h2"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc {kind}, version long, n long, all_h1 array<bigint>, all_h2 array<bigint>")


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc``, ``version``, ``spans`` and ``n`` of every document: where runs begin that aren't the first of their kind, and its number of sentences."""
    ready(df.sparkSession)
    rows = df.select(df[f"`{doc_id}`"].alias("doc"), _version(df[f"`{text}`"]).alias("version"), df[f"`{text}`"].alias("text"))
    hashed = settled(_hashed(rows, least_sentences, least_words))
    runs = hashed.select("doc", "version", "all_h2", F.posexplode("all_h1").alias("at", "h1"))
    runs = runs.select("h1", F.get("all_h2", F.col("at")).alias("h2"), "doc", "version", "at")
    # A set, since rows may repeat an id and text: as many as a document has sentences at most.
    places = first_seen.later(runs, whole_document=False).select("doc", "version", "at", F.lit(None).cast("long").alias("n"))
    numbers = hashed.select("doc", "version", F.lit(None).cast("int").alias("at"), "n")
    return places.unionByName(numbers).groupBy("doc", "version").agg(F.collect_set("at").alias("spans"), F.max("n").alias("n"))


def _version(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(text: str, gone: list[int], least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> tuple[str, int, int]:
    """A text without the sentences of the runs that begin at ``gone``, its sentences before and the number removed."""
    found = sentences(text)
    sizes = run_sizes([s[3] for s in found], least_sentences, least_words)
    removed = np.zeros(len(found) + 1, dtype=np.int64)
    for at in gone:
        removed[at] += 1
        removed[at + sizes[at]] -= 1
    removed = removed.cumsum()[:-1] > 0
    starts = [s[0] for s in found] + [len(text)]
    rest = "".join(text[starts[i] : starts[i + 1]] for i in range(len(found)) if not removed[i])
    return text[: starts[0]] + rest, len(found), int(removed.sum())


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``df`` with shorter texts, and ``n_sentences`` (before) and ``n_removed`` (long) as last columns.

    All rows stay, those whose whole text goes with an empty one.  Null texts
    stay null, very long ones are taken whole; texts without a run are as they were.  Rows that repeat an id and
    text fare alike; null ids come last and count as one document.  Columns
    named like results are replaced; an empty table gives an empty result.
    """
    gone = repeated_spans(df, doc_id, text, least_sentences, least_words)
    kept = [c for c in df.columns if c.lower() not in ("n_sentences", "n_removed")]
    d, v, s, n = (free(kept, x) for x in ("span_doc", "span_version", "spans", "span_sentences"))
    left = df.select(*[df[f"`{c}`"] for c in kept], _version(df[f"`{text}`"]).alias(f"{v}_1"))
    right = gone.select(F.col("doc").alias(d), F.col("version").alias(f"{v}_2"), F.col("spans").alias(s), F.col("n").alias(n))
    both = left.join(right, left[f"`{doc_id}`"].eqNullSafe(right[d]) & (left[f"{v}_1"] == right[f"{v}_2"]), "left").select(*[F.col(f"`{c}`") for c in kept], s, n)
    at = [c.lower() for c in kept].index(text.lower())
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                out = []
                for t, found, number in zip(part.column(at), part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    out.append(without(t.as_py() or "", found, least_sentences, least_words) if found else (t.as_py(), number, 0))
                columns = [*part.columns[:-2], pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())]
                columns[at] = pa.array([x[0] for x in out], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return mapped(both, work, schema)
