"""SimHash of as many bits as a similarity of 0.8 takes, searched by balls that meet in the middle.

Two texts whose sets of shingles have a Jaccard similarity of 0.8 differ in 15 %
of the bits of a SimHash, which are 10 of 64.  No search by few differing bits
finds these.  So a text has several short fingerprints, *blocks*, to be found by,
and 128 further bits to be verified with.  Of each block every text emits the
bits and their variants with one bit flipped: texts meet in a key if a block of
theirs differs by two bits at most, half of them from either side.  What meets
is verified by popcount: texts within ``RADIUS`` of the 128 bits are linked.

Blocks have 18 bits up to ``CROWD`` * 2^18 texts and a bit more for each
doubling, so that keys don't get fuller; there are as many blocks as find all
but ``MISSED`` of the pairs of a similarity of 0.8, and more of closer ones.

A bit is the sign of a sum of what each shingle's hash gives it: a number from
-7.5 to 7.5.  With -1 and 1 instead sums of few shingles are often nought, and
their signs change too easily.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .batches import extended
from .components import components, looked_up
from .session import ready, settled

#: Bits that verify, and how many of them may differ.
VERIFY, RADIUS = 128, 36

#: Least bits of a block, and texts for each value of a block up to which these will do.
BLOCK, CROWD = 18, 64

#: Part of the pairs of similarity 0.8 that may meet in no block; probability that a bit of theirs
#: differs (simulated for all sizes of sets from 4 shingles: at most 0.158, that of 4 and 5 shingles).
MISSED, FLIPPED = 0.001, 0.158

#: Texts of a key up to which pairs are compared side by side, and beyond which a forest is grown.
FEW = 256

#: Texts of a group from which on its size is broadcast, one entry for each group.
HUB = 1_000

#: Fewer shingles than these have no other text within the similarity.
LEAST_SIZE = math.ceil(jaccard.LEAST / (1 - jaccard.LEAST))

#: Shingles that are summed at once.
_AT_ONCE = 1_024

#: Words of 64 bits are sums of eight nibbles at once, of 16 shingles at most.
_NIBBLES, _SHINGLES = np.uint64(0x0F0F0F0F0F0F0F0F), 16


def plan(texts: int) -> tuple[int, int]:
    """Bits of a block and number of blocks for so many texts."""
    bits = max(BLOCK, math.ceil(math.log2(max(1, texts) / CROWD)))
    found = sum(math.comb(bits, n) * FLIPPED**n * (1 - FLIPPED) ** (bits - n) for n in range(3))
    return bits, math.ceil(math.log(MISSED) / math.log(1 - found))


@cache
def _mixers(words: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(jaccard.SEED)
    return rng.integers(0, 1 << 64, words, dtype=np.uint64), rng.integers(0, 1 << 64, words, dtype=np.uint64) | np.uint64(1)


def bits_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` SimHash bits of a set of hashed shingles."""
    turns, factors = _mixers(-(-count // 16))
    sums = np.zeros((2, 8 * len(turns)), np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        mixed = (hashes[at : at + _AT_ONCE, None] ^ turns) * factors
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        starts = np.arange(0, len(mixed), _SHINGLES)
        for half in range(2):
            part = np.add.reduceat(mixed >> np.uint64(4 * half) & _NIBBLES, starts, axis=0)
            sums[half] += part.view(np.uint8).sum(0, dtype=np.int64)
    return (2 * sums > 15 * len(hashes)).ravel()[:count]


def signed(df: DataFrame, text: str, shingle: int, bits: int, blocks: int) -> DataFrame:
    """``df`` without its text, with ``fp`` (hash of all words), ``size`` (number of shingles), ``near`` and ``more`` (128 bits) and ``keys`` (block number and block)."""
    fields = [T.StructField(n, T.LongType()) for n in ("fp", "size", "near", "more")]

    def make():
        count, values = VERIFY + bits * blocks, 1 << np.arange(bits, dtype=np.int64)
        offsets = np.arange(blocks, dtype=np.int64) << bits

        def work(texts: pa.Array) -> list[pa.Array]:
            prints, sizes, found = [], [], np.zeros((len(texts), count), bool)
            for n, t in enumerate(texts):
                words = jaccard.words_of(t.as_py())
                prints.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                hashes = jaccard.shingles(words, shingle)
                sizes.append(len(hashes))
                found[n] = bits_of(hashes, count)
            verify = np.packbits(found[:, :VERIFY], axis=1, bitorder="little").view(np.int64)
            keys = found[:, VERIFY:].reshape(-1, blocks, bits) @ values + offsets
            # Too small sets aren't looked for.
            some = np.array(sizes) >= LEAST_SIZE
            ends = np.concatenate([[0], np.cumsum(some * blocks)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
            return [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(verify[:, n].copy()) for n in (0, 1)), listed]

        return work

    return extended(df, text, [*fields, T.StructField("keys", T.ArrayType(T.LongType()))], make, keep_text=False)


def variants(prints: DataFrame, bits: int) -> DataFrame:
    """``key``, ``near`` and ``more`` of every block and of its variants with one bit flipped."""
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << n).cast("long") for n in range(bits)]])
    blocks = prints.select("near", "more", F.explode("keys").alias("block"))
    spread = blocks.select("near", "more", "block", F.explode(flips).alias("flip"))
    return spread.select(F.col("block").bitwiseXOR(F.col("flip")).alias("key"), "near", "more")


def forest(near: np.ndarray, more: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest among texts at most ``RADIUS`` bits apart."""
    names, near, more, links = near, near.view(np.uint64), more.view(np.uint64), []
    left = np.arange(len(near))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            here = reached.pop()
            close = _apart(near[left], more[left], near[here], more[here]) <= RADIUS
            if close.any():
                links += [(int(names[here]), x) for x in names[left[close]].tolist()]
                reached += left[close].tolist()
                left = left[~close]
    return links


def _apart(near, more, other_near, other_more) -> np.ndarray:
    return np.bitwise_count(near ^ other_near) + np.bitwise_count(more ^ other_more)


def pairs(starts: np.ndarray, ends: np.ndarray, near: np.ndarray, more: np.ndarray) -> list[tuple[int, int]]:
    """All pairs at most ``RADIUS`` bits apart within each run from a start to its end."""
    names, near, more, found = near, near.view(np.uint64), more.view(np.uint64), []
    sizes = ends - starts
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    end, step = np.repeat(ends, sizes), 1
    while True:
        inside = at + step < end
        at, end = at[inside], end[inside]
        if not len(at):
            return found
        close = at[_apart(near[at], more[at], near[at + step], more[at + step]) <= RADIUS]
        found += zip(names[close].tolist(), names[close + step].tolist())
        step += 1


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to the least of what verified pairs among the rows (key, near, more) of equal keys connect; rows come sorted.

    The tasks that meet a large group link it to the same few texts, so that these links are mostly equal.
    """
    from .simhash import _Union

    union, rest = _Union(), tuple(np.zeros(0, np.int64) for _ in range(3))

    def join(key: np.ndarray, near: np.ndarray, more: np.ndarray) -> None:
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        few = ends - starts <= FEW
        for x in pairs(starts[few], ends[few], near, more):
            union.joins(*x)
        for a, b in zip(starts[~few], ends[~few]):
            for x in forest(near[a:b], more[a:b]):
                union.joins(*x)

    for batch in batches:
        now = tuple(np.concatenate([old, c.to_numpy(zero_copy_only=False)]) for old, c in zip(rest, batch.columns))
        if not len(now[0]):
            continue
        # The last key may go on in the next batch.
        cut = int(np.searchsorted(now[0], now[0][-1]))
        rest = tuple(c[cut:] for c in now)
        if cut:
            join(*(c[:cut] for c in now))
    if len(rest[0]):
        join(*rest)
    both = np.array([(r, x) for x in list(union.parent) if (r := union.root(x)) != x], dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def linked(prints: DataFrame, bits: int) -> DataFrame:
    """Links ``a``, ``b`` that connect the ``near`` of distinct ``near``, ``more`` and ``keys`` as all pairs found would."""
    spark = ready(prints.sparkSession)
    # Few bytes become many: a stated number of partitions isn't made smaller by what is in them now.
    dealt = prints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("near", "more"))
    keyed = variants(dealt, bits).repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(_colliding, "a long, b long")


def meeting(distinct: DataFrame, bits: int) -> DataFrame:
    """``key``, ``fp`` and ``size`` of texts that links or equal bits put into one group, with its number ``n`` of texts and ``total`` of shingles.

    ``distinct`` is settled and has ``fp`` and the other columns of ``signed``.
    """
    prints = distinct.filter(F.size("keys") > 0).select("near", "more", "keys").distinct()
    roots = components(linked(prints, bits))
    placed = distinct.filter(F.size("keys") > 0).join(roots, distinct["near"] == roots["node"], "left").select(F.coalesce("root", "near").alias("key"), "fp", "size")
    placed = settled(placed)
    several = placed.groupBy(F.col("key").alias("own")).agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1")
    found = looked_up(placed, "key", several.select("own", "n", F.struct("n", "total").alias("crowd")), "own", "crowd", HUB)
    return found.select("key", "fp", "size", "crowd.n", "crowd.total")
