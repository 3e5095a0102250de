"""Exact sizes, nothing lost, and uniformity, of the matrix and of the shuffle."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelark.llm import queries, sharding


def test_matrix_margins():
    sent, sizes = [5, 0, 17, 100, 1], sharding.even(123, 7)
    assert sizes == [18, 18, 18, 18, 17, 17, 17]
    matrix = sharding.communication_matrix(sent, sizes, 1)
    assert matrix.sum(1).tolist() == sent and matrix.sum(0).tolist() == sizes and (matrix >= 0).all()
    assert sharding.communication_matrix([], [0, 0], 1).shape == (0, 2)


def test_matrix_law():
    """Entries have the mean and the variance of the hypergeometric law."""
    sent, sizes = [30, 50, 20], [40, 60]
    found = np.array([sharding.communication_matrix(sent, sizes, seed)[0, 0] for seed in range(4000)])
    assert abs(found.mean() - 12) < 0.2
    assert abs(found.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.4


def test_draws_from_very_many_rows(monkeypatch):
    """Inversion draws as numpy does, and works where numpy doesn't."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(sharding, "_NUMPY_ROWS", 0)
    for good, bad, sample in ((5, 6, 4), (700, 300, 50), (10, 1000, 400), (3, 3, 6), (0, 5, 2), (5, 0, 2)):
        ours = Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(6000))
        theirs = Counter(rng.hypergeometric(good, bad, sample, 6000).tolist())
        assert sum(abs(ours[k] - theirs[k]) for k in ours | theirs) < 6000 * 0.12
    found = [sharding.hypergeometric(rng, 10**11, 2 * 10**11, 30_000) for _ in range(500)]
    assert abs(np.mean(found) - 10_000) < 20 and 60 < np.std(found) < 100


@pytest.mark.parametrize(("rows", "parts", "target"), [(1000, 7, 1_000_000), (1000, 7, 10), (5, 3, 1_000_000), (240, 1, 4), (0, 2, 5)])
def test_shards(spark, monkeypatch, rows, parts, target):
    monkeypatch.setattr(sharding, "TARGET_ROWS", target)
    frame = spark.range(0, rows, 1, parts).select("id", (F.col("id") % 3).alias("part"))
    found = sharding.shard(frame, 24).collect()
    assert Counter((r.id, r.part) for r in found) == Counter((i, i % 3) for i in range(rows))
    sizes = Counter(r.shard for r in found)
    assert [sizes[s] for s in range(24)] == sharding.even(rows, 24)
    for s in range(24):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s]))


def test_texts_and_hot_keys(spark, monkeypatch, prose):
    """Rows with texts, a third of them equal, in several parts of each shard: all come out whole."""
    monkeypatch.setattr(sharding, "TARGET_ROWS", 20)
    rows = [(i, "the same text" if i % 3 == 0 else prose(i, 30) if i % 10 else None) for i in range(700)]
    found = sharding.shard(spark.createDataFrame(rows, "id long, text string").repartition(5), 6).collect()
    assert sorted((r.id, r.text) for r in found) == rows
    sizes = Counter(r.shard for r in found)
    assert [sizes[s] for s in range(6)] == sharding.even(700, 6)
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s])) for s in range(6))


@pytest.mark.parametrize("rows", [4_000, 700_000])
def test_matrix_of_very_many_partitions(rows):
    """200,000 partitions of 8 * 10^8 rows in all, and 2,000 of 1.4 * 10^9: exact margins, and a few dozen MB on the driver."""
    rng = np.random.default_rng(3)
    parts = 200_000 if rows < 10_000 else 2_000
    sent = rng.integers(0, 2 * rows, parts).tolist()
    sizes = sharding.even(sum(sent), 24)
    if rows > 10_000:
        assert sum(sent) > sharding._NUMPY_ROWS
    matrix = sharding.communication_matrix(sent, sizes, 1)
    assert matrix.nbytes <= 40_000_000
    assert matrix.sum(1).tolist() == sent and matrix.sum(0).tolist() == sizes and matrix.min() >= 0
    # As a uniform shuffle has it: about a 24th each, with the law's spread.
    away = (matrix - np.array(sent)[:, None] / 24) / np.sqrt(np.maximum(np.array(sent)[:, None], 1) * 23 / 24**2)
    assert abs(away.mean()) < 0.01 and abs(away.std() - 1) < 0.02


def test_uniform_in_parts(spark, monkeypatch):
    """Shards that are permuted in several parts are uniform as well."""
    monkeypatch.setattr(sharding, "TARGET_ROWS", 150)
    found = sharding.shard(spark.range(0, 8000, 1, 8), 8, 3).collect()
    table = np.zeros((8, 8))
    for r in found:
        table[r.id // 1000, r.slot // 125] += 1
    assert ((table - 125) ** 2 / 125).sum() < 90
    moved = [r.id for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(moved, range(8000))[0, 1]) < 0.06


def test_shards_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST", 0)
    assert sharding.shard(spark.range(0, 100, 1, 3), 5).groupBy("shard").count().filter("count = 20").count() == 5


def test_same_seed_same_shards(spark):
    a, b, c = ({r.id: (r.shard, r.slot) for r in sharding.shard(spark.range(0, 200, 1, 4), 6, seed).collect()} for seed in (1, 1, 2))
    assert a == b != c


def test_uniform(spark):
    """Where rows come from says nothing about where they go: chi-square of 8 source blocks by 8 shards, and of slots."""
    found = sharding.shard(spark.range(0, 8000, 1, 8), 8, 7).collect()
    table = np.zeros((8, 8))
    halves = Counter()
    for r in found:
        table[r.id // 1000, r.shard] += 1
        halves[r.id % 1000 < 500, r.slot < 500] += 1
    assert ((table - 125) ** 2 / 125).sum() < 90  # 49 degrees of freedom: 90 is passed once in 3000
    assert all(abs(n - 2000) < 200 for n in halves.values())
    moved = [r.id for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(moved, range(8000))[0, 1]) < 0.06


def test_odd_rows(nasty, empty, others):
    found = sharding.shard(nasty, 4)
    others(found, ("shard", "slot"))
    assert [r[1] for r in found.groupBy("shard").count().orderBy("shard").collect()] == [4, 4, 4, 4]
    assert sharding.shard(empty, 4).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all({r.slot for r in rows if r.shard == s} == set(range(sizes[s])) for s in sizes)


def test_no_python(spark):
    plan = sharding.shard(spark.range(100), 4)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
