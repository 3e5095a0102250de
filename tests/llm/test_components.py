"""Components of few links, which one task finds, and of many, which rounds do."""

import random

import numpy as np
import pytest

from pipelark.llm import components as components_module
from pipelark.llm.components import components, roots_of


def expected(links):
    """Nodes that aren't the least of their component, with that."""
    up = {x: x for link in links for x in link}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up if root(x) != x}


SHAPES = {
    "chain": lambda n, rng: list(zip(n, n[1:])),
    "star": lambda n, rng: [(n[0], x) for x in n[1:]],
    "star around the largest": lambda n, rng: [(max(n), x) for x in n if x != max(n)],
    "zigzag": lambda n, rng: list(zip(s := [x for pair in zip(sorted(n), sorted(n)[::-1]) for x in pair][: len(n)], s[1:])),
    "random": lambda n, rng: [(rng.choice(n), rng.choice(n)) for _ in range(len(n) * 3 // 4)],
    "none": lambda n, rng: [],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("few, hub", [(-1, 3), (-1, 100_000), (1_000, 3)])
def test_tasks_and_rounds_find_the_same(spark, monkeypatch, shape, few, hub):
    monkeypatch.setattr(components_module, "FEW", few)
    monkeypatch.setattr(components_module, "HUB", hub)
    rng = random.Random(shape)
    links = SHAPES[shape]([rng.randint(-(2**62), 2**62) for _ in range(150)], rng)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == expected(links)


@pytest.mark.parametrize("shape", SHAPES)
def test_roots_of_many_nodes(shape):
    rng = random.Random(shape)
    for size in (1, 2, 3, 10, 3_000):
        links = SHAPES[shape]([rng.randint(-(2**62), 2**62) for _ in range(size)], rng)
        node, root = roots_of(*np.array(links, np.int64).reshape(-1, 2).T)
        assert dict(zip(node.tolist(), root.tolist())) == expected(links)


def test_few_links_take_few_stages(spark):
    """Rounds take a dozen shuffles each, of as many tasks as there are partitions, however few the links are."""
    rng = random.Random(4)
    nodes = [rng.randint(-(2**62), 2**62) for _ in range(500)]
    links = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few links", "")
    try:
        assert components(links).count() == 499
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few links")) <= 12
