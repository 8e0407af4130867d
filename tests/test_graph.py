import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import forest, graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_on_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(7, 7), (3, 4), (4, 3)]
    got = {x.id: x.component for x in graph.connected_components(edges(spark, pairs)).collect()}
    assert got == brute_components(pairs)


def test_chain_and_empty(spark):
    chain = [(i, i + 1) for i in range(40)]
    assert {x.component for x in graph.connected_components(edges(spark, chain)).collect()} == {0}
    assert graph.connected_components(edges(spark, [])).collect() == []


def split(spark, pairs, **o):
    e = edges(spark, pairs)
    nodes = graph.connected_components(e).join(graph.degrees(e), "id").withColumn("norm", F.format_string("%03d", "id"))
    rows = graph.split_wide(nodes, e, **o).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.piece, (set(), set()))[0].add(r.id)
        pieces[r.piece][1].add(r.flagged)
    return sorted((sorted(i), f == {True}) for i, f in pieces.values())


def test_split(spark):
    star = [(0, i) for i in range(1, 8)]
    assert split(spark, star) == [(list(range(8)), False)]
    chain = [(i, i + 1) for i in range(6)]  # hub 1 reaches 0..3, the rest is far
    assert split(spark, chain) == [([0, 1, 2, 3], True), ([4, 5, 6], True)]
    assert split(spark, [(0, 1), (1, 2), (2, 3)]) == [([0, 1, 2, 3], False)]  # fewer than five nodes
    barbell = [(a, b) for k in (0, 10) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 4), (4, 5), (5, 10)]
    assert split(spark, barbell) == [([0, 1, 2, 3, 4, 5], True), ([10, 11, 12, 13], True)]


def test_distances(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (8, 9)])
    start = spark.createDataFrame([(0, 0)], "piece long, id long")
    assert {(r.id, r.distance) for r in graph.distances(e, start).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


@pytest.mark.parametrize("chunk", [2, 7, 60, 10**6])
@pytest.mark.parametrize("name", ["random", "chain", "dense", "hub", "pairs"])
def test_components_of_many_chunks(spark, chunk, name):
    r = random.Random(9)
    pairs = {
        "random": [(r.randrange(200), r.randrange(200)) for _ in range(150)],
        "chain": [(i, i + 1) for i in range(60)],
        "dense": [(a, b) for a in range(14) for b in range(a)] + [(a, 100 + a) for a in range(14)],
        "hub": [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 60, 7)],
        "pairs": [(2 * i, 2 * i + 1) for i in range(60)],
    }[name]
    got = {x.node: x.root for x in forest.components(edges(spark, pairs + pairs[:9]).repartition(3), chunk).collect()}
    assert got == {k: v for k, v in brute_components(pairs).items() if k != v}


def test_spanning():
    r = random.Random(4)
    for n in (1, 2, 50, 400):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(n)]
        u, v = (np.array(x) for x in zip(*pairs))
        want = brute_components(pairs)
        assert [want.get(i, i) for i in range(n)] == forest.spanning(u, v, n).tolist()
