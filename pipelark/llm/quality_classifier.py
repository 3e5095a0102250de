"""A quality classifier that is trained without labels.

Heuristic labellers, which overlap, vote on every text; a label model
(:mod:`pipelark.llm.label_model`) estimates their accuracies from all votes by
expectation-maximisation.  Its posterior probabilities are the soft labels on
which a linear scorer over hashed features is trained.  Training takes a sample
of texts whose bound is a parameter; the label model and the scoring take all.

The features of a text are the shares, among its words, of hashed word shapes
(letters, capitals, digits and signs in runs), of pairs of neighbouring shapes,
of short words, and of words that were seen just before.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import label_model, quality_rules
from .batches import extended, free
from .label_model import Voter, pattern
from .merges import Memo
from .session import ready

#: Hashed features of a text, and the most texts that training takes.
DIMENSIONS, SAMPLE = 2048, 6000

_SHAPE = (
    (re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "x"),
    (re.compile(r"\d+"), lambda m: "9"),
)


def labellers() -> list[Voter]:
    """The heuristics that vote; several look at the same fault from different sides."""
    share = quality_rules._share
    return [
        Voter("words", F.col("n_words"), 30, 12),
        Voter("signs by character", share("n_symbols", "word_chars"), 0.01, 0.05),
        Voter("words of signs", share("n_sign_words", "n_words"), 0.02, 0.1),
        Voter("marked words", share("n_marked_words", "n_words"), 0.1, 0.25),
        Voter("repeated lines", share("n_dup_lines", "n_lines"), 0.2, 0.5),
        Voter("repeated words", share("n_repeat_words", "n_words"), 0.15, 0.4),
        Voter("distinct words", share("n_distinct_words", "n_words"), 0.5, 0.35),
        Voter("capitals", share("n_capitals", "n_letters"), 0.15, 0.4),
        Voter("sentence ends", share("n_words", "n_ends"), 20, 28),
    ]


def _number(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % DIMENSIONS


def _word(word: str) -> tuple[int, int]:
    """The hashed shape of a word, and the hashed word itself if it is short (else -1)."""
    shape = word
    for pattern_, letter in _SHAPE:
        shape = pattern_.sub(letter, shape)
    return _number("shape " + shape), _number("word " + word.lower()) if len(word) <= 3 else -1


@lru_cache(maxsize=1)
def _words() -> Memo:
    return Memo(_word)


@lru_cache(maxsize=1)
def _gaps() -> np.ndarray:
    return np.array([_number(f"gap {k}") for k in range(8)])


def features(text: str | None) -> np.ndarray:
    """Shares of the hashed features; all zero for a text without words."""
    words = (text or "").split()
    if not words:
        return np.zeros(DIMENSIONS, dtype=np.float32)
    both = np.array([*map(_words().__getitem__, words)], dtype=np.int64)
    shapes, short = both[:, 0], both[:, 1]
    pairs = (shapes[:-1] * 31 + shapes[1:] * 17 + 7) % DIMENSIONS
    # How far back the same word stands, in powers of two.
    numbers: dict[str, int] = {}
    row = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    ranked = np.argsort(row, kind="stable")
    back = (ranked[1:] - ranked[:-1])[row[ranked[1:]] == row[ranked[:-1]]]
    seen = _gaps()[np.log2(back[back < 256]).astype(int)]
    counts = np.bincount(np.concatenate([shapes, short[short >= 0], pairs, seen]), minlength=DIMENSIONS)
    return (counts / len(words)).astype(np.float32)


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 2.0, keep: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighted alike; returns weights and offset."""
    if not len(rows):
        return np.zeros(DIMENSIONS), 0.0
    share = np.clip(labels.mean(), 0.01, 0.99)
    weight = labels * 0.5 / share + (1 - labels) * 0.5 / (1 - share)
    scale = 1 / np.maximum(rows.std(0), 1e-2)
    scaled = rows * scale
    centre = scaled.mean(0)
    scaled = (scaled - centre).astype(np.float32)
    labels, weight = labels.astype(np.float32), weight.astype(np.float32)
    w, b, vw, vb = np.zeros(scaled.shape[1], dtype=np.float32), 0.0, 0.0, 0.0
    step = rate / max(1.0, float((scaled**2).sum(1).mean()))
    for _ in range(rounds):
        off = weight * (1 / (1 + np.exp(-np.clip(scaled @ w + b, -30, 30))) - labels) / len(rows)
        vw, vb = 0.9 * vw + off @ scaled + keep * w, 0.9 * vb + off.sum()
        w, b = w - step * vw, b - step * vb
    return (w * scale).astype(np.float64), float(b - centre @ w)


def sampled(df: DataFrame, total: int, model: label_model.LabelModel, text: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and posterior labels of ``sample`` different texts at most, those of the least hashes.

    A bound on hashes draws about a fifth more than ``sample`` of ``total`` texts; what comes
    to the driver are their vectors of ``DIMENSIONS`` numbers.  Copies of a text are
    drawn together and count once, so that neither partitions nor copies matter.
    """
    draw = F.xxhash64(F.lit("sample"), F.col(f"`{text}`"))
    chance = min(1.0, 1.2 * sample / max(total, 1))
    drawn = df.select(F.col(f"`{text}`").alias("text"), draw.alias("draw")).filter(F.pmod("draw", F.lit(1 << 40)) < int(chance * (1 << 40)))

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows = np.array([quality_rules.measured(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(quality_rules.MEASURES))
            return [pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary()), *[pa.array(rows[:, i]) for i in range(rows.shape[1])]]

        return work

    fields = [T.StructField("features", T.BinaryType()), *[T.StructField(m, T.LongType()) for m in quality_rules.MEASURES]]
    coded = extended(drawn, "text", fields, make, keep_text=False).select("draw", "features", pattern(labellers()).alias("votes"))
    once = coded.groupBy("draw").agg(F.first("features").alias("features"), F.first("votes").alias("votes"))
    found = sorted(once.collect(), key=lambda r: r["draw"])[:sample]
    rows = np.array([np.frombuffer(r["features"], dtype=np.float32) for r in found]).reshape(-1, DIMENSIONS)
    return rows, np.array([model.posterior.get(r["votes"], model.good_share) for r in found])


def quality_scores(df: DataFrame, text: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Every row of ``df`` without its text, with ``weak_label``, ``score`` and ``kept``.

    ``weak_label`` is the label model's posterior, ``score`` the trained scorer's
    probability that the text is good.  Null and empty texts are scored by the
    offset alone and never kept; very long ones are scored whole.  Repeated rows
    and nulls elsewhere change nothing, nor do partitions; columns named like results are replaced; an empty table gives an
    empty result.
    """
    ready(df.sparkSession)
    own = {*quality_rules.MEASURES, "weak_label", "score", "kept"}
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own or c == text])
    measures = quality_rules.measure(rows.select(F.col(f"`{text}`")), text, keep_text=False).select(pattern(labellers()).alias("votes"))
    histogram = {r[0]: r[1] for r in measures.groupBy("votes").count().collect()}
    model = label_model.fit(histogram, len(labellers()))
    weights, offset = train(*sampled(rows, sum(histogram.values()), model, text, sample))
    return scored(rows, model, weights, offset, text, threshold)


def scored(rows: DataFrame, model: label_model.LabelModel, weights: np.ndarray, offset: float, text: str, threshold: float) -> DataFrame:
    """All rows with the scorer's probability and the label model's."""
    score = free([*rows.columns, "score", "kept", "weak_label"], "raw_score")

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            raw = np.array([float(features(t.as_py()) @ weights) + offset for t in texts], dtype=np.float64)
            measures = np.array([quality_rules.measured(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(quality_rules.MEASURES))
            return [pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30)))), *[pa.array(measures[:, i]) for i in range(measures.shape[1])]]

        return work

    fields = [T.StructField(score, T.DoubleType()), *[T.StructField(m, T.LongType()) for m in quality_rules.MEASURES]]
    found = extended(rows, text, fields, make, keep_text=False)
    code = free(found.columns, "votes")
    coded = label_model.posterior(rows.sparkSession, found.withColumn(code, pattern(labellers())), code, model, "weak_label")
    kept = (F.col("n_words") > 0) & (F.col(score) >= threshold)
    names = [c for c in found.columns if c not in (score, *quality_rules.MEASURES)]
    return coded.select(*[F.col(f"`{c}`") for c in names], "weak_label", F.col(score).alias("score"), kept.alias("kept"))
