"""A label model: the accuracies of voters and the true class, estimated from votes alone.

Each of K voters says good (1), bad (-1) or nothing (0) about a row.  Given the
class of a row the votes are taken as independent, with a probability for each
voter, class and vote.  Expectation-maximisation finds these and the share of
good rows; nothing bounds them, so that a voter that errs is overruled.  A fault
is told from the ways of good rows by the votes that come with it: it takes
voters that overlap, as a fault that one voter alone sees may pass for good.

Only the histogram of vote patterns matters, which has 3^K bins at most whatever
the corpus: Spark counts it over all rows, the driver fits it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: More voters than this would make too many bins for the driver.
VOTERS = 10

#: Imagined rows of each class with each vote of a voter; they keep probabilities off 0 and 1.
IMAGINED = 1.0

#: The belief that a row is good at the start, without a bad vote and with some.
START = 0.95, 0.05


@dataclass(frozen=True)
class Voter:
    """Votes on one measure: good on the near side of ``good``, bad on the far side of ``bad``, else nothing.

    With ``good`` below ``bad`` small values are good, otherwise large ones.  A
    voter with ``good`` None only ever says bad or nothing.
    """

    name: str
    measure: Column
    good: float | None
    bad: float

    def vote(self) -> Column:
        """1, 0 or -1; a null or undefined measure is no vote."""
        small = self.good is None or self.good < self.bad
        says_bad = self.measure >= self.bad if small else self.measure <= self.bad
        says = F.when(says_bad, F.lit(-1))
        if self.good is not None:
            says = says.when(self.measure <= self.good if small else self.measure >= self.good, F.lit(1))
        return says.otherwise(F.lit(0))


def pattern(voters: list[Voter]) -> Column:
    """All votes of a row as one number in base three."""
    if len(voters) > VOTERS:
        raise ValueError(f"{VOTERS} voters at most: the bins are kept on the driver")
    code = F.lit(0)
    for i, voter in enumerate(voters):
        code = code + (voter.vote() + 1) * 3**i
    return code.cast("int")


@dataclass(frozen=True)
class LabelModel:
    """``votes[k, c, v]``: probability that voter k says v - 1 of a row of class c (0 bad, 1 good)."""

    good_share: float
    votes: np.ndarray
    posterior: dict[int, float]

    def accuracies(self) -> np.ndarray:
        """For each voter how often a vote that it gives is right."""
        share = np.array([1 - self.good_share, self.good_share])
        right = share[0] * self.votes[:, 0, 0] + share[1] * self.votes[:, 1, 2]
        given = (share[None, :, None] * self.votes[:, :, [0, 2]]).sum((1, 2))
        return right / np.maximum(given, 1e-12)


def fit(histogram: dict[int, int], voters: int, rounds: int = 500, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation on a histogram of patterns.

    It starts from the belief that rows without a bad vote are good and others
    bad.  An empty histogram gives an empty posterior.
    """
    codes = np.array(sorted(histogram), dtype=np.int64)
    weight = np.array([histogram[c] for c in codes], dtype=float)
    seen = codes[:, None] // 3 ** np.arange(voters)[None, :] % 3  # vote + 1
    belief = np.where((seen == 0).any(1), START[1], START[0])
    share, table = 0.5, np.full((voters, 2, 3), 1 / 3)
    hot = np.eye(3)[seen]  # pattern, voter, vote
    for _ in range(rounds if len(codes) else 0):
        by_class = np.stack([weight * (1 - belief), weight * belief])
        share = float((by_class[1].sum() + 1) / (weight.sum() + 2))
        table = np.einsum("cp,pkv->kcv", by_class, hot) + IMAGINED
        table /= table.sum(2, keepdims=True)
        logs = np.einsum("pkv,kcv->pc", hot, np.log(table)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        moved, belief = np.abs(new - belief).max(), new
        if moved < tolerance:
            break
    return LabelModel(share, table, dict(zip(codes.tolist(), belief.tolist())))


def fit_votes(voted: DataFrame, code: str, voters: int) -> LabelModel:
    """The model of all rows of ``voted``; the histogram has 3^voters rows at most."""
    counted = voted.groupBy(code).count().collect()
    return fit({row[0]: row[1] for row in counted}, voters)


def posterior(spark: SparkSession, rows: DataFrame, code: str, model: LabelModel, name: str) -> DataFrame:
    """``rows`` with the probability ``name`` that each is good, by its pattern.

    The table of patterns has 3^voters rows at most, so it is broadcast.
    """
    table = spark.createDataFrame([*model.posterior.items()], f"`{code}` int, `{name}` double")
    return rows.join(F.broadcast(table), code, "left")
