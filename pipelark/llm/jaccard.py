"""Near-duplicates by the Jaccard similarity of their shingles: of texts that SimHash put into a group, whole sets decide.

The texts of a group (`wide_simhash.meeting`) meet with their whole sets, and a
link is made where the similarity is ``LEAST`` or more.  In each group only the
links of a spanning forest are kept.

Most groups fit into a task.  A crowded one is taken apart: all its members are
held against one of them, which links near copies to it; those that are left
form chunks that fit into a task, and each chunk is held against all members,
which stream by.  Tasks differ in members and chunks, so that neither a large
group nor its comparison has to fit into one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import extended
from .session import settled

#: Words of a shingle, seed of its hash, and the similarity of near-duplicates.
SHINGLE, SEED, LEAST = 5, 42, Fraction(4, 5)

#: Shingles and members of a group up to which one task takes it; groups with more are taken apart.
CROWD, MANY = 4_000_000, 100

#: A group of so many shingles that is taken apart is one part; of a hundred times as many, ten parts.
PART = 15_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z made small."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle, or none, are one shingle."""
    spans = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64, len(spans)))


def forest(prints: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest among sets of similarity ``LEAST`` or more."""
    up, down = LEAST.numerator, LEAST.numerator + LEAST.denominator
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [tuple(prints)] if down * both >= up * (len(sets[0]) + len(sets[1])) else []
    sizes = np.array([len(s) for s in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(known), np.int64)
    links, left, here = [], np.arange(len(sets)), []
    while len(left) and (len(left) > 1 or here):
        if not here:
            here, left, flat = [left[0]], left[1:], flat[sizes[left[0]] :]
        at = here.pop()
        marked[parts[at]] = 1
        both = np.add.reduceat(marked[flat], np.cumsum(sizes[left]) - sizes[left])
        marked[parts[at]] = 0
        near = down * both >= up * (sizes[left] + sizes[at])
        if near.any():
            here += left[near].tolist()
            links += [(prints[at], prints[i]) for i in left[near]]
            flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the rows (key, fp, shingles) of equal keys; rows come sorted."""
    from .simhash import _Union

    union, key, prints, sets = _Union(), None, [], []

    def links() -> list[tuple[int, int]]:
        if len(prints) < 2 or len({union.root(p) for p in prints}) == 1:
            return []
        return [x for x in forest(prints, sets) if union.joins(*x)]

    for batch in batches:
        found = []
        ends = batch.column(2).offsets.to_numpy()
        flat = batch.column(2).values.to_numpy().view(np.uint64)
        for i, (k, p) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if k != key:
                found += links()
                key, prints, sets = k, [], []
            prints.append(p)
            sets.append(flat[ends[i] : ends[i + 1]])
        sets = [s.copy() for s in sets]  # what goes on shall not hold the batch
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    pairs = np.array(links(), dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _near(a: str, b: str) -> Column:
    """Whether two sets of shingles have a similarity of ``LEAST`` or more."""
    up, down = LEAST.numerator, LEAST.numerator + LEAST.denominator
    return down * F.size(F.array_intersect(a, b)) >= up * (F.size(a) + F.size(b))


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the chunk and the members of each task (key, chunk, part); its rows (task, member, fp, shingles) come sorted, the chunk first."""
    from .simhash import _Union

    up, down = LEAST.numerator, LEAST.numerator + LEAST.denominator
    union, task, prints, sets, ready_ = _Union(), None, [], [], False
    for batch in batches:
        found = []
        ends = batch.column(3).offsets.to_numpy()
        flat = batch.column(3).values.to_numpy().view(np.uint64)
        for i, (t, member, p) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
            if t != task:
                task, prints, sets, ready_ = t, [], [], False
            own = flat[ends[i] : ends[i + 1]]
            if not member:
                prints.append(p)
                sets.append(own.copy())
                continue
            if not sets:
                continue
            if not ready_:
                sizes = np.array([len(s) for s in sets])
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(every, kind="stable")
                every, owner, ready_ = every[order], owner[order], True
            left, right = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            some = np.flatnonzero(right > left)
            held = owner[np.concatenate([np.arange(left[k], right[k]) for k in some])] if len(some) else owner[:0]
            both = np.bincount(held, minlength=len(sets))
            for k in np.flatnonzero(down * both >= up * (sizes + len(own))).tolist():
                if prints[k] != p and union.joins(prints[k], p):
                    found.append((prints[k], p))
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _parts(total: str) -> Column:
    """In how many parts so many shingles are dealt: few more than fit, yet enough for large groups to be shared by many tasks."""
    return F.ceil(F.greatest(F.col(total) / CROWD, F.sqrt(F.col(total) / PART)))


def _crowded(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` among the members (``key``, ``fp``, ``size``) of crowded groups (``total``: their shingles)."""
    inside = crowds.join(sets, "fp").select("key", "total", "fp", "size", "shingles")
    parts = _parts("total").cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), "fp"), parts)
    # One member of a group stands before all parts of it.
    first = crowds.groupBy("key", "total").agg(F.min("fp").alias("fp")).join(sets, "fp")
    first = first.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("fp").alias("pivot"), F.col("shingles").alias("own"))
    held = inside.withColumn("part", part).join(first, ["key", "part"])
    held = settled(held.select("key", "total", "fp", "size", "pivot", _near("shingles", "own").alias("near")))
    star = held.filter("near and fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
    rest = held.filter("not near")
    # One entry for each group of more than MANY members or CROWD shingles.
    counted = F.broadcast(rest.groupBy("key").agg(F.sum("size").alias("left")).select("key", _parts("left").cast("int").alias("chunks")))
    task = F.struct("key", "chunk", "part").alias("task")
    ours = rest.join(counted, "key").join(sets, "fp").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "fp"), "chunks"))
    ours = ours.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    theirs = inside.join(counted, "key").withColumns({"chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)), "part": part.cast("long")})
    rows = ours.select(task, F.lit(False).alias("member"), "fp", "shingles").unionByName(theirs.select(task, F.lit(True).alias("member"), "fp", "shingles"))
    rows = rows.select(F.xxhash64("task").alias("task"), "member", "fp", "shingles").repartition("task").sortWithinPartitions("task", "member", "fp")
    return star.unionByName(rows.mapInArrow(_against, "a long, b long"))


def linked(meeting: DataFrame, distinct: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links ``a``, ``b`` between near-duplicates of a group.

    ``meeting`` has ``key``, ``fp`` and ``size`` of the members of groups, with the number ``n``
    and ``total`` size of the group's; ``distinct`` has ``fp`` and the hashes ``k1``, ``k2`` of a
    row with that text; ``texts`` has ``k1``, ``k2`` and ``text``, and may repeat rows.
    """
    meeting = settled(meeting)
    some = distinct.join(meeting.select("fp"), "fp").select("fp", "k1", "k2")
    # Repeated rows become one in each task before they move.
    once = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    found = once.join(some, ["k1", "k2"]).select("fp", "text")

    def make():
        return lambda column: [pa.array([shingles(words_of(t.as_py()), shingle).view(np.int64) for t in column], pa.list_(pa.int64()))]

    sets = extended(found, "text", [T.StructField("shingles", T.ArrayType(T.LongType()))], make, keep_text=False)
    large = (F.col("total") > CROWD) | (F.col("n") > MANY)
    crowds = meeting.filter(large)
    crowded = not crowds.isEmpty()
    if crowded:
        sets = settled(sets)
    both = meeting.filter(~large).join(sets, "fp").select("key", "fp", "shingles").repartition("key").sortWithinPartitions("key", "fp")
    links = both.mapInArrow(_verified, "a long, b long")
    return links.unionByName(_crowded(crowds, sets)) if crowded else links
