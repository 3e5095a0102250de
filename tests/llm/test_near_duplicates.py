"""SimHash groups and components against plain union-find over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pipelark.llm import jaccard, queries, simhash
from pipelark.llm import components as components_module
from pipelark.llm.components import components


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    spans = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    """Component of every row (id, fingerprint) over all pairs."""
    union, distinct = Union(), sorted({f for _, f in rows})
    for i, a in enumerate(distinct):
        union.root(a)
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                union.join(a, b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[union.root(f)] = min(i, least.get(union.root(f), i))
    return [(i, f, least.get(union.root(f))) for i, f in rows]


def classes(rows):
    """The least id of each component, once for each; None where there is none."""
    union, distinct = Union(), sorted({f for _, f in rows})
    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 3:
                union.join(a, b)
    return [min((i for i, f in rows if i is not None and union.root(f) == r), default=None) for r in {union.root(f) for f in distinct}]


def test_fingerprints(prose):
    rng = random.Random(3)
    for text in ("", None, " \t", "One", "One two", "One two three", "É É\x1cé \xa0 b", prose(1, 500), *["".join(rng.choice("aB \n\tÉ") for _ in range(40)) for _ in range(50)]):
        assert simhash.fingerprint_of(text) == fingerprint(text)


def test_a_text_of_many_pieces(prose, monkeypatch):
    text = prose(2, 900)
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "_AT_ONCE", 7)
    assert simhash.fingerprint_of(text) == whole


def test_links_lose_nothing(spark):
    """Random fingerprints and their neighbours at every distance up to five, in chains and clusters."""
    rng, prints = random.Random(5), set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            prints.add(f)
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << bit
    prints |= {0, 1, 7, (1 << 64) - 1, 1 << 63, 0xFFFF, 0xFFFE << 48}
    signed = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(sorted(prints, key=lambda f: f * 7919 % 104729))]
    frame = spark.createDataFrame(signed, "doc_id long, fp long")
    found = simhash.groups(frame, "doc_id").collect()
    rows = [(i, f & (2**64 - 1)) for i, f in signed]
    assert sorted((r.doc_id, r.component) for r in found) == sorted((i, c) for i, _, c in expected(rows))


def test_forest_joins_what_pairs_join():
    rng = np.random.default_rng(2)
    for _ in range(100):
        prints = np.unique(rng.integers(0, 1 << 7, rng.integers(1, 40)).astype(np.int64) << 57)
        links = simhash.forest(prints)
        a, b = Union(), Union()
        for x, y in links:
            assert (x ^ y & (2**64 - 1)) and ((x ^ y) & (2**64 - 1)).bit_count() <= 3
            a.join(x, y)
        for i, x in enumerate(prints.tolist()):
            for y in prints[i + 1 :].tolist():
                if ((x ^ y) & (2**64 - 1)).bit_count() <= 3:
                    b.join(x, y)
        assert len(links) < max(1, len(prints))
        assert [a.root(x) for x in prints.tolist()] == [b.root(x) for x in prints.tolist()]


@pytest.mark.parametrize("hub", [3, 100_000])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "pairs", "none"])
def test_components(spark, monkeypatch, shape, hub):
    monkeypatch.setattr(components_module, "HUB", hub)
    rng = random.Random(1)
    nodes = [rng.randint(-(2**62), 2**62) for _ in range(200)]
    links = {
        "chain": list(zip(nodes, nodes[1:])),
        "star": [(nodes[0], n) for n in nodes[1:]],
        "random": [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)],
        "pairs": list(zip(nodes[::2], nodes[1::2])) * 2,
        "none": [],
    }[shape]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    union = Union()
    for a, b in links:
        union.join(a, b)
    assert found == {n: union.root(n) for n in union.up if union.root(n) != n}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = queries.op4_simhash(spark, d).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, f"{f:016x}", c) for i, f, c in expected([(i, fingerprint(t)) for i, t in docs]))


def test_odd_rows(nasty, empty):
    found = simhash.near_duplicates(nasty)
    rows = [(r.doc_id, fingerprint(r.text)) for r in nasty.collect()]
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component) for r in found.collect()), key=lambda x: repr(x)) == sorted(expected(rows), key=lambda x: repr(x))
    assert simhash.near_duplicates(empty).collect() == []


def test_near_dedup_keeps_one_of_each(spark, nasty, empty, prose):
    found = simhash.near_dedup(nasty)
    assert found.columns == nasty.columns
    kept = classes([(r.doc_id, fingerprint(r.text)) for r in nasty.collect()])
    assert sorted(map(repr, (r.doc_id for r in found.collect()))) == sorted(map(repr, kept))
    assert simhash.near_dedup(empty).collect() == []
    # Many copies of one text, of which one row stays, with its own other columns.
    copies = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(prose(1, 60)).alias("text"), (F.col("id") * 2).alias("more"))
    assert [tuple(r)[::2] for r in simhash.near_dedup(copies).collect()] == [(0, 0)]


def test_a_large_group_makes_links_in_proportion(spark):
    """Two thousand fingerprints around one: all linked, by fewer links than there are emitted keys."""
    rng, centre = random.Random(9), random.Random(8).getrandbits(64)
    near = {centre}
    while len(near) < 2000:
        f = centre
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            f ^= 1 << bit
        near.add(f)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in near], "fp long")
    links = simhash.linked(frame)
    assert links.count() < 4 * 2000
    found = components(links)
    assert found.count() == 1999 and found.select("root").distinct().count() == 1


def test_variants_are_made_by_many_tasks(spark):
    """Few bytes before, many after: the fingerprints aren't put together into few tasks."""
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("fp"))
    distinct = rows.groupBy("fp").count().select("fp")
    plan = simhash.linked(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64(fp" in plan and "REPARTITION_BY_NUM" in plan.split("Generate")[-1]


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_dedup_finds_similar_texts_that_differ_by_many_bits(spark, prose):
    """Copies with some words changed: those of a similarity of 0.8 or more go, the others stay."""
    rng, rows, gone, far = random.Random(12), [], set(), 0
    for n in range(60):
        text = prose(n, 200)
        words = text.split()
        for at in rng.sample(range(len(words)), n % 12):
            words[at] = f"changed{at}"
        copy = " ".join(words)
        rows += [(2 * n, text), (2 * n + 1, copy)]
        if similarity(text, copy) >= 0.8:
            gone.add(2 * n + 1)
            far += (fingerprint(text) ^ fingerprint(copy)).bit_count() > 3
    found = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in found.collect()} == set(range(120)) - gone
    assert far > 5 and len(gone) < 60


def test_repeated_rows_are_one_document(spark, prose):
    """A third of all rows is one id and text; of rows that differ elsewhere one stays, the same whatever the partitions."""
    one = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.lit(prose(1, 60)).alias("text"), F.col("id").alias("more"))
    rest = spark.createDataFrame([(100 + n, prose(100 + n, 60), n) for n in range(200)], "doc_id long, text string, more long")
    found = [sorted(map(tuple, simhash.near_dedup(one.union(rest).repartition(n)).collect())) for n in (2, 5)]
    assert found[0] == found[1] and [r[0] for r in found[0]] == [7, *range(100, 300)]


@pytest.mark.parametrize("crowd", [300, 2_000])
def test_crowded_keys_lose_no_link(spark, monkeypatch, prose, crowd):
    """Groups of near copies, some in chains, that don't fit into a task: components are those of all pairs."""
    rng, rows = random.Random(5), []
    for group in range(3):
        words = prose(40 + group, 100).split()
        for n in range(60):
            changed = list(words)
            for at in rng.sample(range(len(words)), rng.choice([1, 1, 2, 3, 4])):
                changed[at] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
            if group == 2 and n % 4 == 0:
                words = changed  # wanders away
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(r.doc_id for r in simhash.near_dedup(texts).collect())
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    made = []
    monkeypatch.setattr(jaccard, "_crowded", lambda *a, f=jaccard._crowded: made.append(1) or f(*a))
    assert sorted(r.doc_id for r in simhash.near_dedup(texts).collect()) == whole and made
    union = Union()
    for i, (_, a) in enumerate(rows):
        union.root(i)
        for j in range(i):
            if similarity(a, rows[j][1]) >= 0.8:
                union.join(i, j)
    assert whole == sorted({union.root(i) for i in range(len(rows))})


def test_forest_of_sets_joins_what_pairs_join():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sets = [np.unique(rng.choice(14, rng.integers(1, 14), replace=False).astype(np.uint64)) for _ in range(rng.integers(2, 30))]
        a, b = Union(), Union()
        links = jaccard.forest(list(range(len(sets))), sets)
        for x, y in links:
            a.join(x, y)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                    b.join(i, j)
        assert len(links) < len(sets)
        assert [a.root(i) for i in range(len(sets))] == [b.root(i) for i in range(len(sets))]
