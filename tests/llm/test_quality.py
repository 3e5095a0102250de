"""Measures against a plain count, the label model against planted votes, and both verdicts against labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipelark.llm import label_model, queries, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(bool(WORD.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), again, len(inside), len(set(words))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é日", "c#", "\n", " ", "\t", "\x0b", "\x1c", "\xa0", "|", "a b a b ", "x\n", "\U0001f600"]), max_size=40).map("".join))
def test_measures(text):
    assert quality_rules.measured(text)[:7] == plain(text)


def test_measures_of_many_distinct_words():
    words = [f"w{i}".encode() for i in range(3000)]

    def counted(words):
        distinct, row = quality_rules.numbered(words)
        return quality_rules.repeated(row, len(distinct)), len(distinct)

    assert counted(words + words[:5]) == (10, 3000)
    assert counted([b"a"] * 5) == (5, 1)
    assert counted([b"a"] * 3) == (0, 1)


def test_measures_of_signs():
    found = dict(zip(quality_rules.MEASURES, quality_rules.measured('One | two--- ### "three" four, | 5.')))
    assert (found["n_words"], found["n_sign_words"], found["n_marked_words"], found["n_ends"]) == (8, 3, 5, 1)


def planted(seed, right, speaks, rows=60_000, share=0.7):
    """Votes (0 bad, 1 none, 2 good) of voters that are right and speak that often, and the truth."""
    rng = np.random.default_rng(seed)
    truth = rng.random(rows) < share
    votes = np.ones((rows, len(right)), int)
    for k, (r, s) in enumerate(zip(right, speaks)):
        says = np.where(rng.random(rows) < r, truth, ~truth)
        votes[:, k] = np.where(rng.random(rows) < s, 2 * says, 1)
    return votes, truth


def coded(votes):
    return (votes * 3 ** np.arange(votes.shape[1])).sum(1).tolist()


def test_label_model_finds_accuracies():
    """Also that of a voter which is hardly better than chance, and is overruled."""
    right, speaks = [0.97, 0.95, 0.93, 0.9, 0.55], [0.9, 0.8, 0.9, 0.7, 0.9]
    votes, truth = planted(1, right, speaks)
    codes = coded(votes)
    model = label_model.fit(dict(Counter(codes)), 5)
    assert abs(model.good_share - 0.7) < 0.02
    assert np.abs(model.accuracies() - right).max() < 0.03
    belief = np.array([model.posterior[c] for c in codes])
    assert ((belief > 0.5) == truth).mean() > 0.97
    alone = (votes[:, 4] == 0) & (votes[:, :4] != 0).all(1) & (votes[:, :4] == 2).any(1)
    assert alone.sum() > 1000 and (belief[alone] > 0.5).all()


def plain_label_model(votes, rounds=500):
    """Expectation-maximisation row by row: the posterior of each row."""
    rows, voters = votes.shape
    belief = [0.05 if (v == 0).any() else 0.95 for v in votes]
    for _ in range(rounds):
        total = sum(belief)
        share = (total + 1) / (rows + 2)
        chance = {}
        for k in range(voters):
            for c in (0, 1):
                held = [1.0, 1.0, 1.0]
                for v, b in zip(votes[:, k].tolist(), belief):
                    held[v] += b if c else 1 - b
                for v in range(3):
                    chance[k, c, v] = held[v] / sum(held)
        new = []
        for v in votes.tolist():
            good, bad = share, 1 - share
            for k, x in enumerate(v):
                good *= chance[k, 1, x]
                bad *= chance[k, 0, x]
            new.append(good / (good + bad))
        moved = max(abs(a - b) for a, b in zip(new, belief))
        belief = new
        if moved < 1e-9:
            break
    return belief


def test_label_model_against_a_plain_one():
    votes, _ = planted(2, [0.95, 0.9, 0.7, 0.85], [0.9, 0.5, 0.9, 0.8], rows=300)
    codes = coded(votes)
    model = label_model.fit(dict(Counter(codes)), 4)
    assert np.allclose([model.posterior[c] for c in codes], plain_label_model(votes), atol=1e-6)


def test_label_model_of_nothing():
    assert label_model.fit({}, 3).posterior == {}


def test_voters(spark):
    frame = spark.createDataFrame([(0.0,), (0.15,), (0.5,), (None,), (float("nan"),)], "x double")
    small, large, only = label_model.Voter("s", F.col("x"), 0.1, 0.3), label_model.Voter("l", F.col("x"), 0.4, 0.1), label_model.Voter("o", F.col("x"), None, 0.3)
    assert [tuple(r) for r in frame.select(small.vote(), large.vote(), only.vote()).collect()][:4] == [(1, -1, 0), (0, 0, 0), (-1, 1, -1), (0, 0, 0)]


def test_report_and_filter(nasty, empty, others):
    own = (*quality_rules.MEASURES, "quality", "base_failed", "kept")
    report = quality_rules.quality_report(nasty)
    others(report, own, ("text",))
    rows = report.collect()
    failed = {r.doc_id: r.base_failed for r in rows}
    assert failed[1] and failed[2] and failed[3] and failed[10] and not failed[6]
    assert not any(r.kept and r.base_failed for r in rows)
    kept = quality_rules.quality_filter(nasty)
    assert kept.columns == nasty.columns
    assert kept.count() == sum(r.kept for r in rows)
    for made in (quality_rules.quality_report(empty), quality_rules.quality_filter(empty)):
        assert made.collect() == []


@pytest.fixture(scope="module")
def labels(spark):
    d = "/root/testdata/sf0.01"
    return d, {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}, {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}


def test_rules_query(spark, labels):
    d, quality, texts = labels
    rows = {r.doc_id: r for r in queries.op1_quality_rules(spark, d).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        words, chars, signs, _, lines, inside, _ = plain(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, signs, lines, inside)
        assert r.base_failed == (words < 50 or 100 * inside > 50 * words)
        assert not (r.kept and r.base_failed)
    long = [i for i in quality if not rows[i].base_failed]
    assert np.mean([rows[i].kept == (quality[i] == 1) for i in long]) > 0.99


def rule_votes(text):
    """The rules' votes, from measures that are counted plainly."""
    n, chars, signs, lines, again, inside, distinct = plain(text)
    words = WORD.findall(text or "")
    marked = [w for w in words if w[0] < "\x80" and not w[0].isalpha() or w[-1] in "!#*$%&|<>"]
    only = [w for w in words if all("!" <= c <= "~" and not c.isalnum() for c in w)]
    letters = [c for c in text or "" if c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    ends = sum(c in ".!?" for c in text or "")
    shares = [
        (n, 50, 20),
        (chars / max(n, 1), 4.6, 4.3),
        (signs / max(chars, 1), 0.01, 0.05),
        (len(marked) / max(n, 1), 0.1, 0.25),
        (len(only) / max(n, 1), 0.02, 0.1),
        (again / max(lines, 1), 0.2, 0.5),
        (inside / max(n, 1), 0.15, 0.4),
        (distinct / max(n, 1), 0.3, 0.15),
        (sum(c.isupper() for c in letters) / max(len(letters), 1), 0.15, 0.4),
        (n / max(ends, 1), 20, 28),
    ]
    return [0 if (x >= bad if good < bad else x <= bad) else 2 if (x <= good if good < bad else x >= good) else 1 for x, good, bad in shares]


def test_quality_and_verdict_against_a_plain_model(spark, labels):
    """Every row's posterior and verdict; some texts with a bad vote are kept, as the model decides."""
    d, _, texts = labels
    ids = sorted(texts)
    votes = np.array([rule_votes(texts[i]) for i in ids])
    expected = plain_label_model(votes)
    rows = {r.doc_id: r for r in queries.op1_quality_rules(spark, d).collect()}
    assert np.allclose([rows[i].quality for i in ids], expected, atol=1e-5)
    assert [rows[i].kept for i in ids] == [b >= 0.5 and not rows[i].base_failed for i, b in zip(ids, expected)]
    assert any(rows[i].kept and (v == 0).any() for i, v in zip(ids, votes))
    accuracy = quality_rules.accuracies(quality_rules.fitted(quality_rules.measure(spark.read.parquet(f"{d}/documents.parquet"))))
    assert len(accuracy) == 10 and min(accuracy.values()) > 0.5


def test_classifier_query(spark, labels):
    """Trained on heuristics alone, held against labels that it never saw."""
    d, quality, texts = labels
    rows = {r.doc_id: r for r in queries.op9_quality_classifier(spark, d).collect()}
    assert len(rows) == len(texts)
    assert np.mean([rows[i].kept for i in quality if quality[i] == 1]) > 0.95
    assert np.mean([rows[i].kept for i in quality if quality[i] == 0]) < 0.15


def plain_features(text):
    """The shares of hashed features, counted one by one."""
    words = (text or "").split()
    out, last = np.zeros(quality_classifier.DIMENSIONS), {}

    def number(feature):
        return xxhash.xxh64_intdigest(feature) % quality_classifier.DIMENSIONS

    shapes = []
    for at, word in enumerate(words):
        shape = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "x", word)
        shapes.append(number("shape " + re.sub(r"\d+", "9", shape)))
        out[shapes[-1]] += 1
        if len(word) <= 3:
            out[number("word " + word.lower())] += 1
        if at:
            out[(shapes[-2] * 31 + shapes[-1] * 17 + 7) % quality_classifier.DIMENSIONS] += 1
        if word in last and at - last[word] < 256:
            out[number(f"gap {(at - last[word]).bit_length() - 1}")] += 1
        last[word] = at
    return out / max(len(words), 1)


def test_scores_against_plain_ones(spark, labels):
    """Weights trained by plain steps on the drawn texts give every row's score."""
    d, _, texts = labels
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    measures = quality_rules.measure(rows).select(label_model.pattern(quality_classifier.labellers()).alias("votes"))
    model = label_model.fit_votes(measures, "votes", len(quality_classifier.labellers()))
    found, soft = quality_classifier.sampled(rows.repartition(7), len(texts), model, "text", 400)
    again, soft_again = quality_classifier.sampled(rows.union(rows), len(texts), model, "text", 400)
    assert len(found) == 400 and (found == again).all() and (soft == soft_again).all()
    share = soft.mean()
    weight = soft * 0.5 / share + (1 - soft) * 0.5 / (1 - share)
    scale = 1 / np.maximum(found.std(0, dtype=np.float64), 1e-2)
    x = found * scale - (found * scale).mean(0)
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, 0.0, 0.0
    step = 2.0 / max(1.0, (x**2).sum(1).mean())
    for _ in range(200):
        off = weight * (1 / (1 + np.exp(-(x @ w + b))) - soft) / len(x)
        vw, vb = 0.9 * vw + off @ x + 1e-4 * w, 0.9 * vb + off.sum()
        w, b = w - step * vw, b - step * vb
    weights, offset = quality_classifier.train(found, soft)
    assert np.allclose(weights, w * scale, atol=1e-2 * np.abs(w * scale).max()) and abs(offset - (b - (found * scale).mean(0) @ w)) < 0.05
    scores = {r.doc_id: r.score for r in quality_classifier.quality_scores(rows, sample=400).collect()}
    for i, text in texts.items():
        assert abs(scores[i] - 1 / (1 + np.exp(-(plain_features(text) @ weights + offset)))) < 1e-4


def test_classifier_on_odd_rows(nasty, empty, others):
    scores = quality_classifier.quality_scores(nasty, sample=8)
    others(scores, ("weak_label", "score", "kept", *quality_rules.MEASURES), ("text",))
    found = {r.doc_id: r for r in scores.collect()}
    assert not found[1].kept and not found[2].kept and not found[4].kept
    assert quality_classifier.quality_scores(empty).collect() == []


def test_features():
    assert not quality_classifier.features(None).any()
    text = "One two, two THREE 44 a" * 3
    assert np.allclose(quality_classifier.features(text), quality_classifier.features(text))
    rng = random.Random(4)
    good = [" ".join(rng.choice(["river", "stone", "walks", "slowly"]) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["RIVER!!", "STONE!!"]) for _ in range(60)) for _ in range(60)]
    rows = np.array([quality_classifier.features(t) for t in good + bad])
    labels = np.array([1.0] * 60 + [0.0] * 60)
    weights, offset = quality_classifier.train(rows[::2], labels[::2])
    assert (((rows[1::2] @ weights + offset) > 0) == (labels[1::2] > 0.5)).all()
