"""Components and strong components against brute force on random graphs, and loops that raise rather than stop half-way."""

import random

import pytest

from factloom.operators import components as stars
from factloom.operators import graph


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_and_cycles_as_by_brute_force(spark, seed):
    random.seed(seed)
    pairs = sorted({(random.randrange(40), random.randrange(40)) for _ in range(55)})
    reach = {a: {b for x, b in pairs if x == a} for a in range(40)}
    for _ in range(40):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    nodes = {x for p in pairs for x in p}
    df = spark.createDataFrame(pairs, "src long, dst long")
    want = {n: min([n, *[m for m in reach[n] if n in reach[m]]]) for n in nodes}
    assert {r["node"]: r["component"] for r in graph.strong_components(df).collect()} == want
    assert {r["node"] for r in graph.cyclic_nodes(df).collect()} == {n for n in nodes if n in reach[n]}


def test_components_of_paths_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(70)] + [(100, 100 + k) for k in range(1, 60)] + [(300, 300)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert set(got.values()) == {0, 100, 300} and len(got) == 71 + 60 + 1


def test_unsettled_loops_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError):
        stars.components(path, rounds=1)
    labels = spark.createDataFrame([(0, "a")], "node long, label string")
    edges = path.toDF("src", "dst")
    with pytest.raises(RuntimeError):
        graph.propagate_unanimous(edges, labels, rounds=3)
