import pytest

from loomfold.operators import demographics


def rows(spark, n):
    data = [(("a", "b", "c")[k % 3], k * 1.0, ("x", "y")[k % 2], ("p", "q", "r")[(k // 3) % 3] if k % 5 else None, k) for k in range(n)] + [(None, 1e9, "x", "p", 1)]
    return spark.createDataFrame(data, "group string, value double, flag string, kind string, other long").selectExpr("*", "1 as variable", "2 as n")


def test_table_of_three_groups(spark):
    got = demographics.demographic_table(rows(spark, 120), [("kind", "Kind"), ("value", "Value"), ("group", "no"), ("gone", "no"), ("flag", "Flag")], "group").collect()
    assert sorted({(r["position"], r["label"]) for r in got}) == [(0, "Kind"), (1, "Value"), (2, "Flag")]
    main = {r["variable"]: r for r in got if r["test"]}
    assert {v: r["test"] for v, r in main.items()} == {"kind": "chi_square", "value": "one_way", "flag": "fisher"}
    assert all(r["group"] is None and r["place"] == 0 and 0 < r["p"] <= 1 and r["q"] >= r["p"] - 1e-12 and r["effect"] is not None for r in main.values())
    value = {r["group"]: r for r in got if r["variable"] == "value"}
    assert value["a"]["n"] == 40 and value["a"]["mean"] == pytest.approx(58.5) and value[None]["n"] == 120 and value[None]["mean"] == pytest.approx(59.5)
    shares = [r["share"] for r in got if r["variable"] == "kind" and r["group"] == "b" and r["place"] > 0]
    assert sum(shares) == pytest.approx(1) and len(shares) == 3
    whole = sorted((r["place"], -r["n"]) for r in got if r["variable"] == "kind" and r["group"] is None and r["place"] > 0)
    assert whole == sorted(whole, key=lambda x: x[1])


def test_small_groups_are_not_compared(spark):
    assert demographics.demographic_table(rows(spark, 90), [("value", "Value"), ("flag", "Flag")], "group").count() == 0
    assert demographics.demographic_table(rows(spark, 93), [("value", "Value")], "group").count() == 4
    assert demographics.demographic_table(rows(spark, 93).limit(0), [("value", "Value")], "group").count() == 0


def test_too_many_groups(spark, monkeypatch):
    monkeypatch.setattr(demographics, "MOST_GROUPS", 2)
    with pytest.raises(ValueError, match="groups"):
        demographics.demographic_table(rows(spark, 120), [("value", "Value")], "group")
