"""Small fixtures worked out by hand, and invariants."""

import pytest
from pyspark.sql import functions as F

from loomfold.functions.quantiles import quantiles
from loomfold.operators import assemble, clean, cluster, evolve, features, fusion, inference, match, pipeline, resample, search, stability
from loomfold.sources import tables
from loomfold.streaming import latest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_partition_agreement_with_itself_is_one(spark):
    labels = spark.createDataFrame([(b, i, (i % 3 + b) % 3) for b in (1, 2) for i in range(12)], "boot long, id long, label long")
    assert [(r["ari"], r["jaccard"]) for r in stability.stability(labels).collect()] == [(1.0, 1.0)]
    m = {r["m"] for r in stability.co_association(labels).collect()}
    assert m == {0.0, 1.0}
    assert stability.pac(stability.co_association(labels)).first()["pac"] == 0


def test_disjoint_resamples_have_no_pair(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 3, 0), (2, 4, 1)], "boot long, id long, label long")
    assert stability.stability(labels).count() == 0


def test_majority_vote_takes_the_smallest_of_equals(spark):
    votes = spark.createDataFrame([(1, 5), (1, 3), (2, 4), (2, 4), (2, 1)], "id long, label long")
    assert rows(stability.majority_vote(votes, ["id"], "label")) == [(1, 3), (2, 4)]


def test_bh_is_monotone_and_not_below_p(spark):
    p = spark.createDataFrame([(k, v) for k, v in enumerate([0.01, 0.04, 0.03, None, 0.9])], "id long, p double")
    got = {r["id"]: r["q"] for r in inference.bh(p, "p", ties=["id"]).collect()}
    assert got[3] is None
    assert [round(got[k], 6) for k in (0, 1, 2, 4)] == [0.04, 0.053333, 0.053333, 0.9]


def test_folds_are_even_and_reruns_agree(spark):
    df = spark.range(101).withColumnRenamed("id", "i")
    one, two = (rows(resample.k_fold(df.repartition(n), "i", "x", 5)) for n in (1, 7))
    assert one == two
    sizes = resample.k_fold(df, "i", "x", 5).groupBy("fold").count().select("count").collect()
    assert sorted(r[0] for r in sizes) == [20, 20, 20, 20, 21]
    assert resample.subsample(df, "i", "x").count() == 80
    assert resample.bootstrap(df, "i", "x").count() == 101
    moved = resample.permute(df.withColumn("v", F.col("i") * 2), "i", "v", "s")
    assert sorted(r["permuted"] for r in moved.collect()) == [2 * k for k in range(101)]


def test_min_cluster_size_without_a_large_cluster_moves_nothing(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, label long")
    d = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 3, 1.0)], "i long, j long, d double")
    assert rows(fusion.min_cluster_size(d, labels, 5)) == rows(labels)
    assert rows(fusion.min_cluster_size(d, labels, 2)) == [(1, 1), (2, 1), (3, 1)]


def test_scale_replays_and_inverts(spark):
    long = spark.createDataFrame([(k, "f", float(v)) for k, v in enumerate([1, 2, 3, 10])] + [(9, "f", None), (1, "g", 5.0), (2, "g", 5.0)], "id long, feature string, value double")
    for kind in ("standard", "minmax", "robust"):
        params = features.fit_scale(long, kind)
        scaled = features.apply_scale(long, params).join(params, "feature")
        back = scaled.select("id", "feature", (F.col("value") * F.col("scale") + F.col("centre")).alias("value"))
        assert [(a, b, c if c is None else round(c, 9)) for a, b, c in rows(back)] == rows(long)


def test_knn_takes_near_donors(spark):
    data = [(1, 0.0, 1.0), (2, 0.1, 2.0), (3, 9.0, 100.0), (4, 0.05, None), (5, None, None)]
    long = spark.createDataFrame([(i, f, v) for i, a, b in data for f, v in (("a", a), ("b", b))], "id long, feature string, value double")
    got = {(r["id"], r["feature"]): r["value"] for r in features.knn_impute(long, k=2).collect()}
    assert got[(4, "b")] == 1.5
    assert got[(5, "b")] is None


def test_power_transform_keeps_order_and_reduces_skew(spark):
    long = spark.createDataFrame([(k, "f", float(k * k * k)) for k in range(-3, 40)], "id long, feature string, value double")
    params = features.fit_power(long)
    got = features.apply_power(long, params)
    assert abs(got.agg(features.adjusted_skew("value")).first()[0]) < 0.5
    values = [r["value"] for r in got.orderBy("id").collect()]
    assert values == sorted(values)


def test_missing_filter_counts_as_defined(spark):
    df = spark.createDataFrame([(1, 1, None, None), (2, 1, 2, None), (3, None, 2, None)], "id long, a int, b int, c int")
    assert clean.missing_filter(df, ["id"], 0.4, 0.5).columns == ["id", "a", "b"]
    assert clean.missing_filter(df, ["id"], 0.4, 0.0).count() == 1


def test_recode_full_and_partial_maps(spark):
    notes = spark.createDataFrame([("x", "1=one;2=two;-900=missing"), ("y", "1=one;2=two")], "name string, notes string")
    values = spark.createDataFrame([("x", 1, "1"), ("x", 2, "2"), ("y", 1, "1"), ("y", 2, "7"), ("y", 3, None)], "name string, id long, value string")
    got = rows(clean.recode(values, clean.parse_notes(notes)).select("name", "id", "recoded"))
    assert got == [("x", 1, "one"), ("x", 2, "two"), ("y", 1, "1=one"), ("y", 2, "7"), ("y", 3, None)]


def test_masked_least_and_totals(spark):
    df = spark.createDataFrame([(1, None, 5, 0, 1), (2, 3, 4, 1, 1), (3, None, None, 1, 1)], "id int, a int, b int, m int, n int")
    assert [r[0] for r in df.orderBy("id").select(match.masked_least(["a", "b"], ["m", "n"])).collect()] == [5, 3, None]
    assert [r[0] for r in df.orderBy("id").select(match.row_total(["a", "b"])).collect()] == [5, 7, None]


def test_pareto_front_equals_brute_force(spark):
    points = [(k, float(k * 7 % 13), float(k * 5 % 11)) for k in range(60)]
    want = {p[0] for p in points if not any(q[1] >= p[1] and q[2] >= p[2] and q[1:] != p[1:] for q in points)}
    got = search.pareto_front(spark.createDataFrame(points, "k long, a double, b double"), ["a", "b"])
    assert {r["k"] for r in got.collect()} == want
    ranks = evolve.fronts([p[1:] for p in points])
    assert {p[0] for p, r in zip(points, ranks, strict=True) if r == 0} == want


def test_objectives_resolve_and_refuse():
    assert evolve.objectives("ari, quality,ari_final") == ["ari_final", "quality_final"]
    with pytest.raises(ValueError):
        evolve.objectives("nonsense")


def test_failed_view_is_told(spark):
    points = spark.createDataFrame([(1, k, [float(k)]) for k in range(4)], "g long, id long, x array<double>")
    got = cluster.cluster_groups(points, ["g"], cluster.Kernel("no such")).collect()
    assert {r["label"] for r in got} == {0} and all(r["status"].startswith("failed") for r in got)


def test_replay_of_the_fitted_table_is_the_fit(spark):
    df = spark.createDataFrame([(k, float(k % 7), float(k * k), None if k % 5 == 0 else float(k % 3)) for k in range(30)], "s long, a_1 double, b double, a_2 double")
    meta = spark.createDataFrame([("a", "one"), ("b", "two")], "variable string, view string")
    out, fitted = pipeline.fit(df, "s", meta)
    near = lambda d: {(r["view"], r["id"], r["feature"]): round(r["value"], 8) for r in d.collect()}
    one, two = near(out), near(pipeline.replay(df, "s", fitted))
    assert one == two and len(one) == 90


def test_assembly_takes_visits_and_nearest_dates(spark):
    one = spark.createDataFrame([("p1", "baseline", "01/10/2024", "5"), ("p1", "m2", "03/10/2024", "7"), ("p2", "baseline", "01/01/2024", "1")], "src_subject_id string, visit string, interview_date string, score string")
    two = spark.createDataFrame([("p1", "01/12/2024", "a"), ("p1", "03/09/2024", "b"), ("p3", "01/01/2024", "c"), ("", "01/01/2024", "z")], "src_subject_id string, interview_date string, lab string")
    got = assemble.assemble([one, two], ["score", "lab"], "month_2")
    assert rows(got.select("id", "score", "lab")) == [("p1", "7", "b"), ("p2", None, None), ("p3", None, "c")]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("nan", None)], "x string, y string")
    path = tables.write_dated(df, str(tmp_path), "baseline", "2024-01-02")
    assert rows(tables.read_csv(spark, path)) == [("a", "1"), (None, None)]
    assert tables.header_columns(spark, path, ["y", "z"]) == ["y"]
    assert tables.list_files(spark, str(tmp_path)).count() >= 1
    registry = tables.Registry(spark, str(tmp_path))
    registry.add("t", df)
    assert registry.read("t") is df
    with pytest.raises(ValueError):
        tables.read_dictionary(spark, path)
    tables.write_generation(df, str(tmp_path / "g"), 1, 2)
    assert spark.read.parquet(str(tmp_path / "g" / "fold=1")).count() == 2


def test_streaming_forms(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "base string, version long, path string").write.parquet(str(source))
    stream = spark.readStream.schema("base string, version long, path string").parquet(str(source))
    query = stream.writeStream.foreachBatch(latest.upsert_newest(str(out), ["base"], "version")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert rows(spark.read.parquet(str(out / "batch=0")).select("base", "version")) == [("a", 3), ("b", 2)]
    seen = latest.earliest_dates(stream, "base", "version").writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    seen.awaitTermination(60)
    assert rows(spark.table("seen")) == [("a", 1), ("b", 2)]


def test_placeholder_dates_become_null(spark):
    days = ["1903-03-03", "1909-09-09", "1901-01-01", "1909-09-01", "1901-09-09", "1900-01-01", "1999-09-09", None]
    frame = spark.createDataFrame([(k, d) for k, d in enumerate(days)], "k int, d string").selectExpr("k", "cast(d as date) as d")
    assert {r["k"] for r in frame.select("k", clean.placeholder_dates_to_null(frame["d"]).alias("d")).filter("d is not null").collect()} == {5, 6}


def test_types_and_levels_of_odd_columns(spark):
    frame = spark.createDataFrame([(1, "x", None, True), (0, "x", None, None)], "a int, b string, c double, d boolean")
    assert {r["variable"]: r["kind"] for r in clean.variable_types(frame, frame.columns).collect()} == {"a": "binary", "b": None, "c": None, "d": "binary"}
    assert clean.variable_types(frame.limit(0), frame.columns).filter("kind is not null").count() == 0


def test_preparation_takes_text_and_replays_it(spark):
    rows = [(k, float(k * k), "low" if k % 3 else "high", f"c{k % 4}", k % 2 == 0) for k in range(40)]
    schema = "id int, m_x double, m_t string, p_c string, p_b boolean"
    meta = spark.createDataFrame([("m", "mood"), ("p", "person")], "variable string, view string")
    specs = spark.createDataFrame([(1, "low", 1), (1, "high", 2)], "set_id int, level string, code int")
    out, fitted = pipeline.fit(spark.createDataFrame(rows, schema), "id", meta, "standard", specs)
    features = {"m_x", "m_t", "p_c_c1", "p_c_c2", "p_c_c3", "p_c_nan", "p_b"}
    assert {r["feature"] for r in out.select("feature").distinct().collect()} == features
    new = [(100 + k, 1.0 * k, "low", "unseen" if k else "c1") for k in range(5)]
    again = pipeline.replay(spark.createDataFrame(new, "id int, m_x double, m_t string, p_c string"), "id", fitted, with_reference=True)
    got = {(r["id"], r["feature"]): r["value"] for r in again.collect()}
    assert {f for _, f in got} == features and all(got[100 + k, "p_b"] is None for k in range(5))  # a column that is not there stays missing
    assert got[100, "p_c_c1"] > got[101, "p_c_c1"]


def test_failed_candidates_are_told(spark):
    rows = [(0, 1, "failed", None, None, None), (0, 2, "final", 1, 0, 0.5), (1, 1, "final", 1, 0, 0.5), (1, 2, "final", 1, 0, 0.5)]
    labels = spark.createDataFrame(rows, "ind long, boot long, view string, id long, label long, score double")
    assert {r["ind"] for r in cluster.completed(labels).collect()} == {1}
    assert cluster.completed(labels, 0.5).count() == 3


def test_fitness_has_every_objective(spark):
    rows = [(i, b, v, k, (k + i * b) % 3 if v == "final" else k % 2, 0.5) for i in (0, 1) for b in (1, 2, 3) for v in ("u", "final") for k in range(12)]
    got = {r["ind"]: r.asDict() for r in evolve.fitness(spark.createDataFrame(rows, "ind long, boot long, view string, id long, label long, score double")).collect()}
    assert set(evolve.OBJECTIVES) <= set(got[0])
    assert got[0]["ari_final"] == got[0]["ccc_final"] == got[0]["coassoc_final"] == got[0]["ari_least"] == 1 and got[1]["ari_views"] == 1


def test_adjusted_chances_standardise_over_the_other_factor(spark):
    """A saturated pattern of counts: with a factor that says nothing more, adjusted chances are the shares; a constant outcome is certain."""
    rows = [(o, s, r) for s in "ab" for r in "xy" for o, n in (("k", 4 if s == "a" else 8), ("l", 6), ("m", 10)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "o string, s string, r string")
    got = {(r["model"], r["level"], r["outcome"]): r for r in inference.predicted_probabilities(frame, "o", "s", ["r"]).collect()}
    for level, n in (("a", 4), ("b", 8)):
        for model in ("unadjusted", "adjusted"):
            r, p = got[model, level, "k"], n / (n + 16)
            assert abs(r["estimate"] - p) < 1e-6 and abs(r["high"] - r["estimate"] - 1.96 * (p * (1 - p) / (2 * (n + 16))) ** 0.5) < 1e-3
    only = inference.predicted_probabilities(frame.filter("o = 'k'"), "o", "s").collect()
    assert [r["estimate"] for r in only] == [1.0, 1.0]
    assert inference.predicted_probabilities(frame.limit(0), "o", "s").count() == 0


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=501).round(2), "b": np.r_[np.zeros(300), [1e9]], "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("a", None), ("a", float("nan")), ("e", None)]
    wanted = {"q0": 0.0, "q25": 0.025, "q500": 0.5, "q750": 0.75, "q1": 1.0}
    for buckets in (1024, 3):
        got = {r["g"]: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", wanted, buckets).collect()}
        assert set(got) == set(groups)
        for g, own in groups.items():
            assert np.allclose([got[g][n] for n in wanted], np.quantile(own, list(wanted.values())))
