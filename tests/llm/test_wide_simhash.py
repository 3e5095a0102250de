"""The SimHash of the pipeline's near-dedup stage against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pipelark.llm import jaccard, simhash, wide_simhash


def test_near_dedup_finds_its_groups_by_simhash(spark, monkeypatch, prose):
    """Without links between fingerprints near copies stay; with them one of each group does."""
    rows = [(2 * n + k, prose(n, 100) + " more" * k) for n in range(5) for k in range(2)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(texts).collect()) == [0, 2, 4, 6, 8]
    monkeypatch.setattr(wide_simhash, "linked", lambda prints, bits: prints.select(F.col("near").alias("a"), F.col("near").alias("b")))
    kept = {r.doc_id for r in simhash.near_dedup(texts).collect()}
    bits, blocks = wide_simhash.plan(len(rows))
    near = [wide_simhash.bits_of(jaccard.shingles(jaccard.words_of(t)), 128 + bits * blocks)[:64] for _, t in rows]
    assert kept == {i for i, _ in rows if i % 2 == 0 or (near[i] != near[i - 1]).any()} and len(kept) > 5


def test_bits(monkeypatch):
    """Each bit is the sign of a sum of nibbles, however many shingles are summed at once."""
    rng = np.random.default_rng(3)
    for size in (1, 15, 16, 17, 100):
        hashes = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        turns, factors = wide_simhash._mixers(2)
        sums = np.zeros((2, 2, 8), int)  # half, word, byte
        for h in hashes.tolist():
            for w in range(2):
                x = ((h ^ int(turns[w])) * int(factors[w])) % 2**64
                x = ((x ^ x >> 32) * 0x94D049BB133111EB) % 2**64
                x ^= x >> 29
                for byte in range(8):
                    for half in range(2):
                        sums[half, w, byte] += 2 * (x >> 8 * byte + 4 * half & 15) - 15
        plain = (sums > 0).ravel().tolist()
        monkeypatch.setattr(wide_simhash, "_AT_ONCE", 1_024)
        assert wide_simhash.bits_of(hashes, 32).tolist() == plain and wide_simhash.bits_of(hashes, 20).tolist() == plain[:20]
        monkeypatch.setattr(wide_simhash, "_AT_ONCE", 7)
        assert wide_simhash.bits_of(hashes, 32).tolist() == plain


@pytest.mark.parametrize("texts", [0, 10_000, 1 << 28])
@pytest.mark.parametrize("a, b, both", [(4, 5, 4), (9, 9, 8), (45, 45, 40), (80, 100, 80)])
def test_pairs_of_similarity_from_08_meet(texts, a, b, both):
    bits, blocks = wide_simhash.plan(texts)
    rng, found = np.random.default_rng(1), 0
    for _ in range(600):
        hashes = rng.integers(0, 1 << 64, a + b - both, dtype=np.uint64)
        apart = wide_simhash.bits_of(hashes[:a], 128 + bits * blocks) != wide_simhash.bits_of(hashes[a - both :], 128 + bits * blocks)
        found += apart[:128].sum() <= wide_simhash.RADIUS and (apart[128:].reshape(blocks, bits).sum(1) <= 2).any()
    assert found >= 596


def test_pairs_and_forests_join_the_same(monkeypatch):
    rng = random.Random(4)
    for few in (0, 256):
        monkeypatch.setattr(wide_simhash, "FEW", few)
        rows = []
        for key in range(12):
            near, more = rng.getrandbits(64), rng.getrandbits(64)
            for _ in range(rng.choice([1, 2, 9, 30])):
                flips = rng.sample(range(128), rng.choice([0, 20, 60]))
                near ^= sum(1 << f for f in flips if f < 64)
                more ^= sum(1 << f - 64 for f in flips if f >= 64)
                rows.append((key, near, more))
        columns = [np.array([r[n] for r in rows], np.uint64).view(np.int64) for n in range(3)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "near", "more"])
        cut = rng.randrange(len(rows))
        union = simhash._Union()
        for i, x in enumerate(rows):
            for j, y in enumerate(rows[:i]):
                if x[0] == y[0] and (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count() <= wide_simhash.RADIUS:
                    union.joins(int(columns[1][i]), int(columns[1][j]))
        wanted = {(union.root(x), x) for x in list(union.parent) if union.root(x) != x}
        found = [(r["a"], r["b"]) for part in wide_simhash._colliding(iter([batch.slice(0, cut), batch.slice(cut)])) for r in part.to_pylist()]
        assert set(found) == wanted and len(found) == len(wanted) > 5
