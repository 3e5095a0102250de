"""Connected components of links between 64-bit nodes, by alternating star contraction.

Every round draws the neighbours of a node to the smallest node near it: first
those above the node (large star), then the node and those below (small star).
Links only ever get nearer to stars around the smallest node of a component,
and the number of rounds grows with the logarithm of its size.  Minima are found
by aggregation, which combines before the shuffle.  What goes back to the links
is joined in two ways: the minima of nodes with very many links, of which there
are few, are broadcast, so that no task gets all links of such a node; the
others are shuffled.  Rounds are cut off from each other by checkpoints.

A round costs a dozen shuffles however few its links are.  So as many links as
surely fit into a task (``FEW``) are solved by one, without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import settled


#: Links (or rows) from which on a node is a hub.
HUB = 100_000

#: Links up to which one task finds the components: 16 bytes each, and ten times that while it does.
FEW = 1_000_000


def _minima(links: DataFrame, node: str, other: str) -> DataFrame:
    """Of each ``node`` the least of itself and its ``other`` ends, and the number ``n`` of these."""
    return links.groupBy(F.col(node).alias("node")).agg(F.least(F.col("node"), F.min(other)).alias("least"), F.count("*").alias("n"))


def looked_up(rows: DataFrame, key: str, table: DataFrame, own: str, value: str, hub: int | None = None) -> DataFrame:
    """``rows`` with the ``value`` that ``table`` has for their ``key``; rows of no known key go.

    ``table`` has each key once (as ``own``) and the number ``n`` of its rows.  What it
    has for the keys of hubs is broadcast, one entry for at least ``hub`` rows (``HUB``
    unless given); other keys are shuffled, and have few rows each.
    """
    hub = HUB if hub is None else hub
    hubs = table.filter(F.col("n") >= hub).select(F.col(own).alias("hub"), F.col(value).alias("of_hub"))
    others = table.filter(F.col("n") < hub).select(F.col(own).alias("other"), F.col(value))
    known = rows.join(F.broadcast(hubs), F.col(key) == F.col("hub"), "left")
    rest = known.filter("hub is null").join(others, F.col(key) == F.col("other"))
    found = known.filter(F.col("hub").eqNullSafe(F.col(key)))
    return rest.select(*rows.columns, value).unionByName(found.select(*rows.columns, F.col("of_hub").alias(value)))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a: the centre; its larger neighbours move to the least node of the star.
    moved = looked_up(both.filter("b > a"), "a", _minima(both, "a", "b"), "node", "least")
    return moved.select(F.col("least").alias("a"), "b").filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # b: the centre; it and its smaller neighbours move to the least of these.
    least = _minima(links, "b", "a")
    moved = looked_up(links, "b", least, "node", "least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("least").alias("a"), F.col("node").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links that aren't the least of their component, and these least ones.

    Trees hang themselves under the least tree that a link leads to.  One that is less than all
    its neighbours gets one of these, or a lesser neighbour for the next turn: half go in two turns.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and roots of all links of the task."""
    ends = [np.zeros((2, 0), np.int64), *(np.stack([c.to_numpy(zero_copy_only=False) for c in x.columns]) for x in batches)]
    node, root = roots_of(*np.concatenate(ends, axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node that has a link.

    ``links`` has the columns ``a`` and ``b``; links to itself don't count.  A
    root has no row of its own.
    """
    # Settled, as what makes the links may be costly and each round reads them several times.
    now = settled(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    if now.count() <= FEW:
        return settled(now.repartition(1).mapInArrow(_solved, "node long, root long"))
    before = None
    while True:
        now = settled(_small_star(_large_star(now)))
        # The links are stars when a round changes nothing; sums of hashes tell, whatever the order.
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = sign
