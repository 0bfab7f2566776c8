"""Cases that earlier versions told wrongly."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfold.functions import kernels
from loomfold.functions.quantiles import quantiles
from loomfold.operators import clean, features, fusion, inference
from loomfold.streaming import latest


def test_a_code_told_twice_has_its_first_label(spark):
    notes = spark.createDataFrame([("v", "1=a;1=b;2=c")], "name string, notes string")
    values = spark.createDataFrame([("v", 1, "1"), ("v", 2, "2")], "name string, id long, value string")
    got = clean.recode(values, clean.parse_notes(notes)).collect()
    assert sorted((r["id"], r["recoded"]) for r in got) == [(1, "a"), (2, "c")]


def test_usable_tables_count_rows(spark):
    rows = [("a", None)] * 31 + [("b", 1)] * 31 + [("c", 1)] * 2
    frame = spark.createDataFrame(rows, "g string, v long")
    assert [tuple(r) for r in clean.usable_tables(frame, "g", ["v"]).collect()] == [("v", True)]
    assert [tuple(r) for r in clean.usable_tables(frame.filter("g <> 'b'"), "g", ["v"]).collect()] == [("v", False)]
    assert [tuple(r) for r in clean.usable_tables(frame.limit(0), "g", ["v"]).collect()] == [("v", False)]


def test_fisher_of_three_levels_is_null(spark):
    rows = [("three", g, lv) for g in "ab" for lv in "xyz"] + [("two", g, lv) for g in "ab" for lv in "xy"] + [("one", "a", "x"), ("two", None, "q")]
    got = {r["variable"]: r["p"] for r in inference.fisher(spark.createDataFrame(rows, "variable string, group string, level string")).collect()}
    assert got == {"three": None, "two": pytest.approx(1.0), "one": None}


def test_dotted_names_and_too_many_levels(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "a", True, 2.0), (2, "b", None, 3.0), (3, None, False, None)], "id long, `x.y` string, `b.c` boolean, `n.m` double")
    specs = spark.createDataFrame([], "set_id int, level string, code int")
    got, frozen = features.dummy_code(frame, "id", specs)
    assert got.columns == ["id", "x.y_b", "x.y_nan", "b.c", "n.m"]
    assert sorted(map(tuple, got.collect()))[1] == (2, 1, 0, None, 3.0)
    again, _ = features.dummy_code(frame.limit(1), "id", specs, frozen)
    assert again.columns == got.columns
    monkeypatch.setattr(features, "MOST_LEVELS", 1)
    with pytest.raises(ValueError, match="x.y"):
        features.dummy_code(frame, "id", specs)


def test_quantiles_survive_outliers(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(4000)] + [("a", 1e12), ("a", -1e308), ("a", 1e308)] + [("b", 5.0)] * 700 + [("c", float(k % 7)) for k in range(999)] + [("d", None), ("e", 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    wanted = {"low": 0.25, "mid": 0.5, "high": 0.9}
    want = {k: [float(np.quantile([v for g, v in rows if g == k], q)) for q in wanted.values()] for k in "abce"}
    for small in (None, 0):
        got = {r["k"]: [r["low"], r["mid"], r["high"]] for r in quantiles(frame, ["k"], "v", wanted, buckets=16, small=small, fine=40).collect()}
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_a_linkage_acts_on_the_hierarchical_member():
    """Two chains of points near each other: only single linkage keeps a chain together."""
    x = np.array([[k * 1.0, 0.0] for k in range(20)] + [[k * 1.0, 2.5] for k in range(20)])
    d, same = kernels.together(x, 2)
    share = {}
    for method in ("single", "complete"):
        own = kernels.cut(kernels.linkage(d, method), len(x), 2)
        share[method] = own[:, None] == own
    assert not (share["single"] == share["complete"]).all()
    both = kernels.cut_together(d, np.zeros_like(same), 2, "single")
    assert len(set(both[:20])) == len(set(both[20:])) == 1 and both[0] != both[20]
    apart = kernels.cut_together(d, np.zeros_like(same), 2, "complete")
    assert len(set(apart[:20])) == 2


def test_fused_pairs_in_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(fusion, "BLOCK_IDS", 7)
    rows = [(v, k, (k * (v + 2)) % 3) for v in range(2) for k in range(40)]
    got = {(r["i"], r["j"]): r["d"] for r in fusion.disagreement(spark.createDataFrame(rows, "view long, id long, label long")).collect()}
    label = {(v, k): x for v, k, x in rows}
    assert got == {(i, j): sum(label[v, i] != label[v, j] for v in range(2)) for i in range(40) for j in range(i + 1, 40)}


def test_late_events_are_left_out(spark, tmp_path):
    """A second run goes on from the first's checkpoint: its late row changes nothing, its other rows count."""
    schema = "ts timestamp, kind string"

    def add(name, rows):
        spark.createDataFrame(rows, "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def counts():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return {(str(r["start"]), r["kind"]): r["count"] for r in latest.run_once(latest.windowed_counts(stream, "ts", "kind"), str(tmp_path / "out"), ["start", "kind"]).collect()}

    add("one", [("2024-01-01 10:00:00", "a"), ("2024-01-05 10:00:00", "a")])
    assert counts() == {("2024-01-01 00:00:00", "a"): 1, ("2024-01-05 00:00:00", "a"): 1}
    add("two", [("2024-01-01 11:00:00", "a"), ("2024-01-05 09:30:00", "a"), ("2024-01-06 00:00:00", "b")])
    assert counts() == {("2024-01-01 00:00:00", "a"): 1, ("2024-01-05 00:00:00", "a"): 2, ("2024-01-06 00:00:00", "b"): 1}
