"""Near-duplicates by SimHash, with balls that meet in the middle.

Two fingerprints of at most three differing bits are to be linked.  Of the four
blocks of 16 bits leave out one in which they differ: at most two differing bits
remain, and two fingerprints at distance two meet in a variant one bit away from
either.  So every distinct fingerprint emits, for each block left out, the other
48 bits and their variants with one bit flipped: 196 keys, each half the
remaining radius away.  Keys are shuffled and sorted; fingerprints with a common
key collide and are verified.  Among those that collide in one place only the
links of a spanning forest are kept, so that a large group of near copies makes
links in proportion to its size; components are the same as with all links.

A key holds at most 49 * 2^16 distinct fingerprints, whatever the corpus.
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

from . import jaccard, wide_simhash
from .batches import extended
from .components import components, looked_up
from .session import ready, settled

BITS, BLOCK, RADIUS = 64, 16, 3

#: Words of a shingle and seed of its hash.
SHINGLE, SEED = 3, 42

#: Shingles whose bits are unpacked at once.
_AT_ONCE = 65_536


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as an unsigned number.

    A-Z are made small and words are split at the six ASCII white-space
    characters.  A text of fewer words than a shingle has its whole sequence as
    its only shingle; one without words has the fingerprint 0.
    """
    words = (text or "").encode().lower().split()  # of bytes: lower() and split() know ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        spans = [line]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-1].tolist()]
        ends = (ends - 1).tolist()
        spans = [line[a:b] for a, b in zip(starts, ends[shingle - 1 :])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in spans), dtype="<u8", count=len(spans))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        part = hashes[at : at + _AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "simhash", shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """``df`` with the fingerprint of each text as a (signed) long."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint_of(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64))]

        return work

    return extended(df, text, [T.StructField(name, T.LongType())], make, keep_text)


def _masks() -> list[tuple[int, int, int]]:
    """(block, mask of the other blocks, bit to flip or 0) of the 196 keys."""
    out = []
    for block in range(BITS // BLOCK):
        inside = range(block * BLOCK, (block + 1) * BLOCK)
        mask = sum(1 << i for i in range(BITS) if i not in inside)
        out += [(block, mask, 0), *((block, mask, 1 << i) for i in range(BITS) if i not in inside)]
    return out


def variants(prints: DataFrame) -> DataFrame:
    """``key`` and ``block`` of every variant of the distinct fingerprints ``fp``."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    rows = F.array(*[F.struct(F.lit(b).cast("byte").alias("block"), F.lit(signed(m)).alias("mask"), F.lit(signed(f)).alias("flip")) for b, m, f in _masks()])
    spread = prints.select("fp", F.explode(rows).alias("v"))
    return spread.select(F.col("v.block").alias("block"), F.col("fp").bitwiseXOR(F.col("v.flip")).bitwiseAND(F.col("v.mask")).alias("key"), "fp")


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest among fingerprints at most ``RADIUS`` bits apart.

    From each new fingerprint its neighbours are searched among those not yet
    reached, so that a close group is left after few steps.
    """
    left, links = prints.view(np.uint64), []  # numpy counts the bits of absolute values
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            here = reached.pop()
            near = np.bitwise_count(left ^ here) <= RADIUS
            if near.any():
                found = left[near]
                links += [(int(here.view(np.int64)), x) for x in found.view(np.int64).tolist()]
                reached += list(found)
                left = left[~near]
    return links


class _Union:
    """The links of a task that join what its earlier links haven't."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links among the rows of equal (block, key); rows come sorted."""
    union = _Union()
    rest = (np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def links(block: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        found = []
        edges = np.flatnonzero((block[1:] != block[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            found += [x for x in forest(fp[a:b]) if union.joins(*x)]
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        now = tuple(np.concatenate([old, c.to_numpy(zero_copy_only=False)]) for old, c in zip(rest, batch.columns))
        block, key, fp = now
        if not len(key):
            continue
        # The last key may go on in the next batch.
        same = np.flatnonzero((block != block[-1]) | (key != key[-1]))
        cut = int(same[-1]) + 1 if len(same) else 0
        rest = tuple(c[cut:] for c in now)
        if cut:
            yield links(*(c[:cut] for c in now))
    if len(rest[1]):
        yield links(*rest)


def linked(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct fingerprints ``fp`` as all pairs within the radius would."""
    spark = ready(prints.sparkSession)
    # Few bytes become many: a stated number of partitions isn't made smaller by what is in them now.  They
    # are dealt by another hash, as an exchange by the one they have would be left out.
    dealt = prints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    keyed = variants(dealt).repartition("block", "key").sortWithinPartitions("block", "key")
    return keyed.mapInArrow(_colliding, "a long, b long")


def groups(rows: DataFrame, least: str) -> DataFrame:
    """``rows`` (``fp`` and others, settled) with ``component``: the smallest ``least`` of all rows within reach.

    Rows of equal fingerprints are taken together first, and what stands for
    them is looked up by each row, so that no task gets all rows of a frequent one.
    """
    distinct = rows.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n"))
    found = settled(_least(distinct, linked(distinct.select("fp"))))
    return looked_up(rows, "fp", found, "fp", "component")


def _least(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """The distinct ``fp`` with ``component``: the smallest ``least`` of all that links connect."""
    roots = components(links)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(distinct["*"], F.coalesce("root", distinct["fp"]).alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(smallest, "root").select(*distinct.columns, "component")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component`` (the smallest reachable id) of every row of ``df``.

    Null and empty texts have the fingerprint 0 and are linked like others; very
    long ones count whole; null ids count only where a component has no other.  Rows that repeat an id stay
    as they are; an empty table gives an empty result.
    """
    rows = fingerprints(df.select(df[f"`{doc_id}`"].alias("doc_id"), df[f"`{text}`"].alias("text")), "text", "fp", shingle, keep_text=False)
    return groups(settled(rows), "doc_id")


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = jaccard.SHINGLE) -> DataFrame:
    """One row of ``df`` of each component: that of the smallest id (null ids last, then the smallest hash of the text).

    SimHash of as many bits as that takes (`wide_simhash`) puts texts into groups by
    balls, popcount and components; those of a group whose shingles have a Jaccard
    similarity of ``jaccard.LEAST`` or more are linked.  Rows that repeat an id and
    text are one document, of which one row stays (that of the smallest hash).
    Null and empty texts are near-duplicates of each other; very long ones are
    compared whole.  Columns are those of ``df``; an empty table gives an empty result.
    """
    names = df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))])
    at, of = (f"c{[c.lower() for c in names].index(x.lower())}" for x in (doc_id, text))
    keyed = rows.withColumns({"k1": F.xxhash64(at, of), "k2": F.xxhash64(F.lit(1), at, of)})
    small = keyed.select(F.col(at).alias("doc_id"), "k1", "k2", F.col(of).alias("text"))
    # Null ids come last, and texts tell apart rows of one id.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    # Of equal texts only the first can stay.
    bits, blocks = wide_simhash.plan(df.count())
    made = wide_simhash.signed(small, "text", shingle, bits, blocks)
    first = made.groupBy("fp").agg(F.min(F.struct(place.alias("place"), "size", "near", "more", "keys")).alias("first"))
    distinct = settled(first.select("fp", F.col("first.place").alias("least"), "first.size", "first.near", "first.more", "first.keys", "first.place.k1", "first.place.k2"))
    links = jaccard.linked(wide_simhash.meeting(distinct, bits), distinct, small.select("k1", "k2", "text"), shingle)
    stay = _least(distinct.select("fp", "least"), links).select("component.k1", "component.k2").distinct()
    # Repeated rows become one in each task before they move, so that their number doesn't matter.
    plain = [F.col(c) for c, kind in rows.dtypes if not re.search("map<|variant", kind)]
    once = keyed.groupBy("k1", "k2").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*plain)).alias("row"))
    return once.join(stay, ["k1", "k2"]).select("row.*").toDF(*names)


def hexadecimal(fp: str):
    """A fingerprint in 16 small hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
