"""Steps over pairs that have to spread over tasks and hold no more than blocks, and the same results by a plainer way."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfold.functions import kernels
from loomfold.operators import features, fusion, linkages, quality, stability, trees
from loomfold.plans import resampling


def sets(spark, n=60, boots=4):
    rows = spark.range(n).withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(boots)))).filter("(id * 7 + boot) % 5 > 0")
    return rows.select("boot", "id", F.expr("(id * id * boot + id) % (boot + 2)").alias("label"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_fused_pairs_are_not_broadcast_nor_aggregated(spark):
    views = sets(spark).withColumnRenamed("boot", "view")
    for fuse in (fusion.agreement, fusion.disagreement, fusion.consensus):
        found = plan(fuse(views))
        pairs = found[: found.index("ShuffledHashJoin")]
        assert "Aggregate" not in pairs and "Broadcast" not in pairs
    frame = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (1, 2, 5), (2, 2, None), (3, 3, 1)], "view long, id long, label long")
    assert rows(fusion.agreement(frame)) == [(1, 2, 0.5)]  # a missing label disagrees; without a common view no pair


def test_co_association_makes_pairs_once(spark):
    found = plan(stability.co_association(sets(spark)))
    assert "Aggregate" not in found[: found.index("ShuffledHashJoin")]
    labels = {}
    for boot, i, label in sets(spark).collect():
        labels.setdefault(i, {})[boot] = label
    want = []
    for i in labels:
        for j in labels:
            both = labels[i].keys() & labels[j].keys()
            if i < j and both:
                want.append((i, j, round(sum(labels[i][b] == labels[j][b] for b in both) / len(both), 9)))
    assert rows(stability.co_association(sets(spark))) == sorted(want)


def test_consensus_of_clusters_from_kinds_is_that_of_pairs(spark):
    own = sets(spark)
    reference = own.filter("boot = 2").select("id", "label")  # some ids have no cluster
    pairs = stability.co_association(own)
    assert rows(stability.cluster_consensus_of(own, reference)) == rows(stability.cluster_consensus(pairs, reference))
    assert rows(stability.certainty_of(own, reference)) == rows(stability.certainty(pairs, reference))


def test_silhouette_in_blocks_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 7)
    points = spark.range(40).select("id", (F.col("id") * 5 % 3).alias("label"), F.array((F.col("id") * 1.7) % 5, (F.col("id") * 0.3) % 2).alias("x"), (F.col("id") % 2).alias("g"))
    points = points.withColumn("label", F.when(F.col("id") == 0, 9).otherwise(F.col("label")))  # a cluster of one
    for keys in ([], ["g"]):
        want, own = [], points.select(*keys, "id", "label", "x").collect()
        for r in own:
            near = {}
            for o in own:
                if o["id"] != r["id"] and all(o[k] == r[k] for k in keys):
                    near.setdefault(o["label"], []).append(math.dist(r["x"], o["x"]))
            means = {c: sum(v) / len(v) for c, v in near.items()}
            a, b = means.pop(r["label"], None), min(means.values())
            want.append((*(r[k] for k in keys), r["id"], 0.0 if a is None else round((b - a) / max(a, b), 9)))
        assert rows(quality.silhouette(points, keys)) == sorted(want)
    assert "Lambda" not in plan(quality.silhouette(points)) and "lambda" not in plan(quality.silhouette(points))  # distances are no expression of a pair's row


def test_distances_are_not_made_by_the_task_that_reads_the_table(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("s_suppkey"), (F.col("id") * 1.5).alias("s_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = resampling.supplier_distances(spark, str(tmp_path))
    assert found.count() == 50 * 49 // 2
    assert "Broadcast" not in plan(found) and found.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("method", kernels.LINKAGES)
def test_linkage_in_rounds_is_that_of_a_matrix(spark, monkeypatch, method):
    monkeypatch.setattr(linkages, "LAST", 12)
    monkeypatch.setattr(linkages, "BLOCK", 25)
    x = np.random.default_rng(3).normal(size=(50, 2))
    merges = kernels.linkage(kernels.distances(x), method)
    points = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    tree = linkages.merge_tree(points, method)
    assert np.allclose(sorted(r["height"] for r in tree.collect()), sorted(merges[:, 2]), atol=1e-6)
    label = kernels.cut(merges, 50, 6)
    first = [3 * int(np.flatnonzero(label == c).min()) for c in label]
    assert rows(linkages.linked(points, method, 6)) == [(3 * i, f) for i, f in enumerate(first)]


def test_linkages_of_one_point_and_of_a_table_hold_no_group_of_all(spark):
    one = spark.createDataFrame([(1, [0.0])], "id long, x array<double>")
    for method in kernels.LINKAGES:
        assert rows(linkages.linked(one, method, 3)) == [(1, 1)]


def test_imputation_meets_in_blocks_and_repeats_are_one_question(spark, monkeypatch):
    """Before, every row with a gap was joined with every donor; equal rows are now asked once, and equal donors give k at most."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(120, 3)), 1)
    x[rng.random(x.shape) < 0.15] = np.nan
    x = np.concatenate([x, x[:60], x[:60]])
    rows = [(k, f, None if np.isnan(v) else float(v)) for k, row in enumerate(x) for f, v in zip("abc", row, strict=True)]
    long = spark.createDataFrame(rows, "id long, feature string, value double")
    square = (x[:, None] - x) ** 2
    far = np.round(np.sqrt(3 / np.maximum(1, (~np.isnan(square)).sum(2)) * np.nansum(square, axis=2)), 9)
    far[(~np.isnan(square)).sum(2) == 0] = np.inf
    want = {}
    for k, c in np.argwhere(np.isnan(x)):
        near = sorted((far[k, j], j) for j in range(len(x)) if not np.isnan(x[j, c]) and np.isfinite(far[k, j]))[:7]
        want[k, "abc"[c]] = np.mean([x[j, c] for _, j in near]) if near else None
    for asked, given in ((512, 4096), (7, 11)):
        monkeypatch.setattr(features, "QUERIES_AT_ONCE", asked)
        monkeypatch.setattr(features, "DONORS_AT_ONCE", given)
        got = {(r["id"], r["feature"]): r["value"] for r in features.knn_impute(long).collect()}
        assert len(got) == len(rows)
        assert {k: got[k] for k in want} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    met = features._offers(["a", "b", "c"], 7)
    table = pa.table({"id": [1, 2, 3, 4], "x": [[1.0, None, 2.0], [1.0, 3.0, 2.0], [1.0, 4.0, 2.0], [None, 9.0, None]], "gives": [False, True, True, True], "p": [0] * 4, "q": [0] * 4})
    assert met(table).column("donor").to_pylist() == [2, 3]


@pytest.mark.parametrize("method", ["single", "complete", "weighted", "centroid", "ward"])
def test_linkage_of_repeated_points_is_that_of_a_matrix(spark, monkeypatch, method):
    """Before, of equal points one pair a round could merge."""
    monkeypatch.setattr(linkages, "LAST", 12)
    monkeypatch.setattr(linkages, "BLOCK", 25)
    monkeypatch.setattr(trees, "BLOCK", 9)
    x = np.repeat(np.random.default_rng(8).normal(size=(30, 2)), 3, axis=0)
    merges = kernels.linkage(kernels.distances(x), method)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    tree = linkages.merge_tree(points, method)
    assert np.allclose(sorted(r["height"] for r in tree.collect()), sorted(merges[:, 2]), atol=1e-6)
    first, again = trees.collapsed(points)
    assert first.count() == 30 and again.count() == 60


def test_spanning_tree_meets_only_slabs_that_are_near(spark, monkeypatch):
    """Before, each round compared all pairs of blocks."""
    met, real = [], trees._met
    monkeypatch.setattr(trees, "BLOCK", 20)
    monkeypatch.setattr(trees, "_met", lambda at, pairs, tasks: met.append(pairs.count()) or real(at, pairs, tasks))
    points = spark.createDataFrame([(k, [k * 0.1, (k % 2) * 0.5]) for k in range(200)], "id long, x array<double>")
    tree = trees.spanning_tree(points)
    want = sorted(m[2] for m in kernels.linkage(kernels.distances(np.array([[k * 0.1, (k % 2) * 0.5] for k in range(200)])), "single"))
    assert np.allclose(sorted(r["height"] for r in tree.collect()), want)
    assert max(met) < 30  # of 55 pairs of ten slabs


@pytest.mark.parametrize("centres", [0, 10**6])
@pytest.mark.parametrize("method", ["complete", "average", "weighted"])
def test_linkages_compare_near_clusters_only(spark, monkeypatch, method, centres):
    """Before, every round made the distances of all points."""
    for name, value in (("LAST", 40), ("CENTRES", centres), ("BLOCK", 20), ("PART", 2)):
        monkeypatch.setattr(linkages, name, value)
    monkeypatch.setattr(trees, "BLOCK", 30)
    monkeypatch.setattr(linkages, "_nearest", None)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2)) * [8, 1]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    tree = linkages.merge_tree(points, method).collect()
    want = kernels.linkage(kernels.distances(x), method)
    assert sorted(r["height"] for r in tree) == pytest.approx(sorted(m[2] for m in want))
