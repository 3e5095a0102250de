"""Quality rules by weak supervision.

Rules vote that a text is good or bad, or abstain.  A label model
(:mod:`pipelark.llm.label_model`) estimates from the votes on all texts how far
each rule is to be trusted, and a text stays if its posterior probability of
being good is high enough.  Rules overlap, so that a fault has several votes, and
look at different things, so that none says again what another has said.  Texts that fail the base limits (too few words, or
mostly repeated ones) go in any case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import extended, free
from .label_model import LabelModel, Voter, fit_votes, pattern, posterior
from .session import ready, settled

#: Base limits: fewest words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_letters", "n_capitals", "n_marked_words", "n_sign_words", "n_ends")


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and for each word which of them it is."""
    numbers: dict[bytes, int] = {}
    row = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    return [*numbers], row


def repeated(row: np.ndarray, m: int) -> int:
    """How many of the words (numbers below ``m``) lie in windows of three that occur twice or more."""
    if len(row) < 4:
        return 0
    if m < 2_000_000:
        windows = (row[:-2] * m + row[1:-1]) * m + row[2:]
    else:  # the product would not fit: number the pairs first
        pairs = np.unique(row[:-2] * m + row[1:-1], return_inverse=True)[1]
        windows = pairs * m + row[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(row), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(windows)] |= twice
    return int(inside.sum())


def measured(text: str | None) -> tuple[int, ...]:
    """The measures of one whole text, in the order of ``MEASURES``; all zero for null and empty texts (but one line)."""
    data = (text or "").encode()
    words = data.split()  # of bytes: exactly the six white-space characters split
    bins = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    points = len(text or "") - int(bins[list(SPACES)].sum())
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.strip())
        else:
            seen.add(line)
    distinct, row = numbered(words)
    often = np.bincount(row, minlength=len(distinct)).tolist()
    capitals = int(bins[65:91].sum())
    marked = [(w, n) for w, n in zip(distinct, often) if not w[:1].isalpha() and w[0] < 128 or w[-1] in b"!#*$%&|<>"]
    return (
        len(words),
        points,
        int(bins[list(SYMBOLS)].sum()),
        len(lines),
        again,
        repeated(row, len(distinct)),
        len(distinct),
        capitals + int(bins[97:123].sum()),
        capitals,
        sum(n for _, n in marked),
        sum(n for w, n in marked if not w.translate(None, SIGNS)),
        int(bins[list(b".!?")].sum()),
    )


def measure(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the measures of every text as long columns; columns of the same names are replaced."""
    ready(df.sparkSession)

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows = np.array([measured(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(MEASURES))
            return [pa.array(rows[:, i]) for i in range(len(MEASURES))]

        return work

    return extended(df, text, [T.StructField(m, T.LongType()) for m in MEASURES], make, keep_text)


def _share(part: str, whole: str):
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> list[Voter]:
    """The rules in use; a share is of words, lines or letters."""
    return [
        Voter("words", F.col("n_words"), LEAST_WORDS, 20),
        Voter("word length", _share("word_chars", "n_words"), 4.6, 4.3),
        Voter("symbols", _share("n_symbols", "word_chars"), 0.01, 0.05),
        Voter("marked words", _share("n_marked_words", "n_words"), 0.1, 0.25),
        Voter("words of signs", _share("n_sign_words", "n_words"), 0.02, 0.1),
        Voter("repeated lines", _share("n_dup_lines", "n_lines"), 0.2, 0.5),
        Voter("repeated words", _share("n_repeat_words", "n_words"), 0.15, 0.4),
        Voter("distinct words", _share("n_distinct_words", "n_words"), 0.3, 0.15),
        Voter("capitals", _share("n_capitals", "n_letters"), 0.15, 0.4),
        Voter("sentence ends", _share("n_words", "n_ends"), 20, 28),
    ]


def base_failed():
    """The base limits, on measured rows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def fitted(measures: DataFrame) -> LabelModel:
    """The label model of all measured rows."""
    return fit_votes(measures.select(pattern(rules()).alias("votes")), "votes", len(rules()))


def accuracies(model: LabelModel) -> dict[str, float]:
    """For each rule how often a vote that it gives is right, as the model estimates it."""
    return dict(zip((r.name for r in rules()), model.accuracies().tolist()))


def judged(measures: DataFrame, model: LabelModel, threshold: float) -> DataFrame:
    """Measured rows with ``base_failed``, ``quality`` (the posterior) and ``kept``."""
    code = free(measures.columns, "votes")
    voted = measures.withColumns({"base_failed": base_failed(), code: pattern(rules())})
    scored = posterior(measures.sparkSession, voted, code, model, "quality").drop(code)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality_report(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every row of ``df`` without its text, with measures, posterior and verdict.

    Null and empty texts have no words and fail the base limits; a very long text
    is measured whole, by itself.  Repeated rows and rows with nulls elsewhere are
    judged like others; columns that are named like results are replaced; an
    empty table gives an empty result.
    """
    own = {*MEASURES, "base_failed", "quality", "kept"}
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own or c == text])
    measures = settled(measure(rows, text, keep_text=False))
    return judged(measures, fitted(measures), threshold)


def quality_filter(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that stay, with its own columns only.

    Null and empty texts fail the base limits and go.  Repeated rows stay or go
    together; nulls and names of other columns don't matter; a very long text is
    measured whole; an empty table gives an empty result.  The measures are taken twice, once for the model and once beside the rows,
    so that no text is written in between.
    """
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    source = renamed.columns[[c.lower() for c in df.columns].index(text.lower())]
    model = fitted(measure(renamed.select(source), source, keep_text=False))
    rows = judged(measure(renamed, source), model, threshold)
    return rows.filter("kept").select(*renamed.columns).toDF(*df.columns)
