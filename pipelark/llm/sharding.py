"""Uniform shuffling into shards of exact sizes, in DataFrame operations only.

How many rows each partition sends to each shard is drawn first, as a matrix
from the law that a uniform permutation induces (multivariate hypergeometric, row
by row).  Then every partition permutes its rows and deals them out by its row
of the matrix, rows are exchanged, and every shard permutes what it got.  All
permutations of the rows are equally likely, and shard sizes differ by one at most.

A large shard is permuted by several tasks: rows are dealt to parts of the shard
by a hash, the parts are counted, and each permutes its rows into a range of
slots behind those of the parts before it.  The matrix has one number for each
partition and shard, however large shards are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import free
from .session import settled

#: Rows of a part of a shard to aim at, and entries of the matrix (of eight bytes) up to which it is broadcast.
TARGET_ROWS, BROADCAST = 1_000_000, 8_000_000

#: numpy draws exactly below this many rows.
_NUMPY_ROWS = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn without replacement are among the ``good`` ones."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    if good + bad < _NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, sample))
    # By inversion, over all values that a number of 53 random bits can tell from the rest.
    total = good + bad
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    spread = int(12 * (sample * (good / total) * (bad / total)) ** 0.5) + 40
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=float)
    steps = np.log(good - k[:-1]) + np.log(sample - k[:-1]) - np.log(k[1:]) - np.log(bad - sample + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(chances, rng.random() * chances[-1], side="right").clip(max=len(k) - 1)])


def even(total: int, parts: int) -> list[int]:
    """``total`` in ``parts`` numbers that differ by one at most, the larger ones first."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def communication_matrix(sent: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows from each partition to each shard: row sums are ``sent``, column sums ``sizes``."""
    rng = np.random.default_rng(seed)
    left = np.array(sizes, dtype=np.int64)
    matrix = np.zeros((len(sent), len(sizes)), dtype=np.int64)
    total = int(left.sum())
    for p, rows in enumerate(sent):
        if total < _NUMPY_ROWS:
            matrix[p] = rng.multivariate_hypergeometric(left, rows) if rows else 0
        else:
            rest, others = rows, total
            for t, room in enumerate(left.tolist()):
                others -= room
                matrix[p, t] = hypergeometric(rng, room, others, rest)
                rest -= int(matrix[p, t])
        left -= matrix[p]
        total -= rows
    return matrix


def _ends_up_to(ends: Column, rank: Column, n: int) -> Column:
    """How many of ``n`` ascending ``ends`` are at most ``rank``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ends, at + step - 1) <= rank, at + step).otherwise(at))


def shard(df: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """``df`` with ``shard`` (0 on, int) and ``slot`` (its place in the shard, 0 on, long).

    Sizes of shards differ by one at most, the larger ones first.  What rows
    hold doesn't matter: nulls, repeated rows and hot keys are dealt out like
    others; very long texts move whole.  Columns named like results are replaced; an empty table gives an
    empty result.  The rows are written to the checkpoint folder once, so that
    the partitions that were counted are the ones that are dealt out.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    draw, place, part, rank, sends, target = (free([*kept, "shard", "slot"], x) for x in ("draw", "place", "part", "rank", "sends", "target"))
    rows = settled(df.select(*[df[f"`{c}`"] for c in kept]))
    # One number for each partition of the input.
    counted = sorted((r[0], r[1]) for r in rows.groupBy(F.spark_partition_id()).count().collect())
    total, parts = sum(n for _, n in counted), max(1, len(counted))
    each = max(1, -(-total // (shards * TARGET_ROWS)))
    matrix = communication_matrix([n for _, n in counted], even(total, shards), seed)
    # Row by row the ranks at which the next shard begins, as texts: these are small on the driver.
    ends = [(p, ",".join(map(str, row.cumsum().tolist()))) for (p, _), row in zip(counted, matrix)]
    table = rows.sparkSession.createDataFrame(ends, f"`{part}` int, `{sends}` string").withColumn(sends, F.split(sends, ",").cast("array<bigint>"))
    if matrix.size <= BROADCAST:
        table = F.broadcast(table)
    # Permute within partitions: after the sort, a row's number in its partition is its rank.
    mixed = rows.withColumn(draw, F.rand(seed)).sortWithinPartitions(draw).withColumn(place, F.monotonically_increasing_id())
    ranked = mixed.withColumns({part: F.shiftright(place, 33).cast("int"), rank: F.col(place).bitwiseAND((1 << 33) - 1)})
    dealt = ranked.join(table, part).withColumn(target, _ends_up_to(F.col(sends), F.col(rank), shards).cast("int"))
    # Exchange, and permute again within shards, large ones in parts.
    own = F.pmod(F.xxhash64(F.lit(-1 - seed), F.col(place)), F.lit(each)) if each > 1 else F.lit(0).cast("long")
    dealt = dealt.select(*[F.col(f"`{c}`") for c in kept], target, place, own.alias(part))
    order = Window.partitionBy(target, part).orderBy(F.xxhash64(F.lit(seed), F.col(place)), F.col(place))
    begin = F.lit(0)
    if each > 1:
        # The rows, partitions and draws are the same again, and so are the parts.
        sizes = dealt.groupBy(target, part).count()
        before = Window.partitionBy(target).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        # One number for each ``TARGET_ROWS`` rows.
        begins = sizes.select(F.col(target).alias(draw), F.col(part).alias(rank), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(sends))
        dealt = dealt.join(F.broadcast(begins), (dealt[target] == begins[draw]) & (dealt[part] == begins[rank]))
        begin = F.col(sends)
    slots = dealt.withColumn("slot", begin + F.row_number().over(order) - 1)
    return slots.select(*[F.col(f"`{c}`") for c in kept], F.col(target).cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
