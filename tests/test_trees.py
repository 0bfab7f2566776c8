"""Spanning trees in rounds against a dense linkage."""

import random

import numpy as np
import pytest

from loomfold.functions import kernels
from loomfold.operators import stability, trees


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize(("block", "few"), [(2048, 50_000), (40, 1)])
def test_tree_has_the_merge_heights_of_single_linkage(spark, monkeypatch, block, few):
    monkeypatch.setattr(trees, "BLOCK", block)
    monkeypatch.setattr(trees, "FEW", few)
    x = np.random.default_rng(block).normal(size=(90, 3))
    x[40] = x[41]  # a height of 0
    tree = trees.spanning_tree(frame(spark, x)).collect()
    assert len(tree) == 89 and all(r["u"] < r["v"] for r in tree)
    for r in tree:
        assert r["height"] == pytest.approx(np.linalg.norm(x[r["u"]] - x[r["v"]]))
    want = sorted(m[2] for m in kernels.linkage(kernels.distances(x), "single"))
    assert sorted(r["height"] for r in tree) == pytest.approx(want)
    labels = kernels.cut(kernels.linkage(kernels.distances(x), "single"), 90, 4)
    got = {r["id"]: r["cluster"] for r in trees.cut_tree(frame(spark, x), trees.spanning_tree(frame(spark, x)), k=4).collect()}
    assert len({(labels[k], c) for k, c in got.items()}) == 4 == len(set(got.values()))
    assert all(c == min(k for k, o in got.items() if o == c) for c in got.values())


def test_equal_heights_make_one_tree(spark, monkeypatch):
    grid = [(i, j) for i in range(6) for j in range(6)]
    one = {(r["u"], r["v"]) for r in trees.spanning_tree(frame(spark, grid)).collect()}
    monkeypatch.setattr(trees, "BLOCK", 5)
    assert {(r["u"], r["v"]) for r in trees.spanning_tree(frame(spark, grid).repartition(7)).collect()} == one and len(one) == 35


def test_chains_are_kept_together(spark):
    x = [(k * 0.1, (k % 2) * 5.0) for k in range(200)]
    got = {r["id"]: r["cluster"] for r in trees.single_linkage(frame(spark, x), k=2).collect()}
    assert got == {k: k % 2 for k in range(200)}
    assert {r["cluster"] for r in trees.single_linkage(frame(spark, x), height=0.05).collect()} == set(range(200))


def test_degenerate_tables(spark):
    assert trees.spanning_tree(frame(spark, [(1.0,)])).count() == 0
    assert trees.spanning_tree(frame(spark, [(1.0,)]).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, [0.0]), (2, None), (None, [1.0]), (3, [2.0])], "id long, x array<double>").selectExpr("*", "7 as comp", "8 as block")
    assert [tuple(r) for r in trees.spanning_tree(rows).collect()] == [(1, 3, 2.0)]
    assert sorted(map(tuple, trees.single_linkage(rows, k=5).collect())) == [(1, 1), (3, 3)]


def test_consensus_tree_equals_dense_linkage(spark):
    rng = random.Random(4)
    labels = [(b, k, (k % 3) if rng.random() < 0.8 else rng.randrange(3)) for b in range(6) for k in range(30) if rng.random() < 0.9]
    sets = spark.createDataFrame(labels, "boot long, id long, label long")
    m = stability.co_association(sets)
    ids = sets.select("id").distinct()
    tree = trees.consensus_tree(m, ids).collect()
    dense = np.ones((30, 30)) - np.eye(30)
    for r in m.collect():
        dense[r["i"], r["j"]] = dense[r["j"], r["i"]] = 1 - r["m"]
    assert sorted(r["height"] for r in tree) == pytest.approx(sorted(x[2] for x in kernels.linkage(dense, "single")))
    lone = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    got = trees.consensus_tree(spark.createDataFrame([(1, 2, 0.75)], "i long, j long, m double"), lone).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0.25), (1, 9, 1.0)]


@pytest.mark.parametrize(("few", "many"), [(0, 10**6), (0, 40)])
def test_links_of_a_long_chain_are_joined(spark, monkeypatch, few, many):
    """Before, more than FEW links took a round of joins for each step along a chain of random names."""
    monkeypatch.setattr(trees, "FEW", few)
    monkeypatch.setattr(trees, "MANY", many)
    names = random.Random(3).sample(range(10_000), 400)
    links = [(a, b) for k, (a, b) in enumerate(zip(names, names[1:], strict=False)) if k % 100 != 99]
    comps = spark.createDataFrame([(k, k) for k in names], "id long, comp long")
    calls, real = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df: calls.append(1) or real(df))
    got = dict(map(tuple, trees.merged(comps, spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {k: min(names[i // 100 * 100 : i // 100 * 100 + 100]) for i, k in enumerate(names)}
    assert len(calls) < 30
