"""Fixed margins: draws, Monte-Carlo tests and the exact network test against enumeration."""

import itertools
import math
import random

import numpy as np
import pytest

from loomfold.functions import special
from loomfold.operators import margins, stability


def compositions(total, parts):
    if len(parts) == 1:
        if total <= parts[0]:
            yield (total,)
        return
    for x in range(min(total, parts[0]) + 1):
        for rest in compositions(total - x, parts[1:]):
            yield (x, *rest)


def enumerated(first, sizes):
    """p of the exact test: all first rows of the margins that are no likelier than the one seen."""
    chance = {x: math.prod(math.comb(c, k) for c, k in zip(sizes, x)) for x in compositions(sum(first), sizes)}
    seen = chance[tuple(first)]
    return sum(w for w in chance.values() if w <= seen * (1 + 1e-7)) / sum(chance.values())


def rows_of(name, table):
    return [(name, f"g{i}", f"l{j}") for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]


def test_exact_test_equals_enumeration(spark):
    rng, rows, want = random.Random(1), [], {}
    for t in range(24):
        k = rng.randint(2, 5)
        table = [[rng.randint(0, 6 if k > 3 else 9) for _ in range(k)] for _ in range(2)]
        for j in range(k):
            table[0][j] += not (table[0][j] or table[1][j])
        table[0][0] += not any(table[0])
        table[1][0] += not any(table[1])
        if sum(map(sum, table)) > 40:
            continue
        want[f"t{t}"] = enumerated(table[0], [a + b for a, b in zip(*table)])
        rows += rows_of(f"t{t}", table if t % 3 else list(zip(*table)))
    rows += rows_of(None, [[3, 1], [1, 4]]) + rows_of("one", [[3, 4, 5]]) + rows_of("wide", [[5, 1, 1], [1, 6, 1], [0, 1, 7]]) + [("t0", None, "l0"), ("t0", "g0", None)]
    want[None] = enumerated([3, 1], [4, 5])
    got = {r["test"]: r for r in margins.fisher(spark.createDataFrame(rows, "test string, group string, level string"), ["test"], 2000).collect()}
    assert len(want) > 15 and set(got) == {*want, "one", "wide"}
    for name, p in want.items():
        assert got[name]["p"] == pytest.approx(p, abs=1e-9), name
        assert got[name]["method"] == ("hypergeometric" if got[name]["groups"] == got[name]["levels"] == 2 else "network")
    assert got["one"]["p"] is None and got["one"]["method"] == "none"
    assert got["wide"]["method"] == "sampled" and got["wide"]["p"] < 0.01


def test_crowded_network_is_sampled(spark, monkeypatch):
    rows = spark.createDataFrame(rows_of("a", [[9, 5, 7, 4], [4, 8, 5, 9]]), "test string, group string, level string")
    exact = margins.fisher(rows, ["test"]).first()
    monkeypatch.setattr(margins, "MOST_NODES", 3)
    other = margins.fisher(rows, ["test"]).first()
    assert (exact["method"], other["method"]) == ("network", "sampled")
    assert exact["p"] == pytest.approx(other["p"], abs=0.03)


def test_draws_have_the_margins_and_the_moments():
    rng = np.random.default_rng(0)
    g, c = np.array([7, 0, 12, 5]), np.array([10, 3, 11])
    drawn = margins.dealt(g, c, 20_000, rng)
    assert (drawn.sum(axis=2) == g).all() and (drawn.sum(axis=1) == c).all() and drawn.min() >= 0
    assert drawn.mean(axis=0) == pytest.approx(np.outer(g, c) / 24, abs=0.05)
    # Each table of a two by two margin as often as its chance.
    two = margins.dealt(np.array([3, 4]), np.array([2, 5]), 60_000, rng)[:, 0, 0]
    for k in range(3):
        assert (two == k).mean() == pytest.approx(math.comb(2, k) * math.comb(5, 3 - k) / math.comb(7, 3), abs=0.01)
    large = margins.dealt(np.array([4 * 10**9, 6 * 10**9]), np.array([5 * 10**9, 5 * 10**9]), 400, rng)
    assert (large.sum(axis=2) == [4 * 10**9, 6 * 10**9]).all() and abs(large[:, 0, 0].mean() - 2 * 10**9) < 2 * 10**4


def test_monte_carlo_p_is_near_the_asymptotic_one(spark):
    rng = random.Random(4)
    rows = [(t, rng.choice("ab"), rng.choice("xyz") if t else rng.choice("xyzx")) for t in (0, 1, None) for _ in range(900)]
    rows += [(2, g, "x" if g == "a" else rng.choice("xy")) for g in "aaaaaaaaaabbbbbbbbbbbb"] + [(3, "a", "x")] * 4 + [(4, None, "x")]
    frame = spark.createDataFrame(rows, "k long, group string, level string")
    got = {r["k"]: r for r in margins.monte_carlo(frame, ["k"], 4000).collect()}
    assert set(got) == {0, 1, 2, 3, None}
    for k in (0, 1, None):
        assert got[k]["p"] == pytest.approx(special.chi2_upper(got[k]["chi2"], got[k]["df"]), abs=0.04) and got[k]["replicates"] == 4000
    assert got[3]["p"] is None and got[3]["replicates"] == 0
    again = {r["k"]: r["p"] for r in margins.monte_carlo(frame.repartition(7), ["k"], 4000).collect()}
    assert again == {k: r["p"] for k, r in got.items()}
    assert margins.monte_carlo(frame.limit(0), ["k"]).count() == 0
    whole = margins.monte_carlo(frame.filter("k = 0").drop("k"), [], 1000).first()
    assert whole["chi2"] == pytest.approx(got[0]["chi2"]) and abs(whole["p"] - got[0]["p"]) < 0.06


def test_wide_tables_have_no_p(spark, monkeypatch):
    monkeypatch.setattr(margins, "MOST_CELLS", 5)
    rows = rows_of("wide", [[2, 3, 4], [4, 3, 1]]) + rows_of("ok", [[2, 3], [4, 1]])
    got = {r["k"]: r for r in margins.monte_carlo(spark.createDataFrame(rows, "k string, group string, level string"), ["k"], 100).collect()}
    assert got["wide"]["p"] is None and got["ok"]["p"] > 0


def test_agreement_against_margins(spark):
    rng = random.Random(8)
    truth = {k: rng.randrange(3) for k in range(80)}
    same = [(b, k, v if rng.random() < 0.9 else rng.randrange(3)) for b in range(4) for k, v in truth.items()]
    chance = [(b, k, rng.randrange(3)) for b in range(4) for k in truth]
    p = []
    for rows in (same, chance):
        frame = spark.createDataFrame(rows, "boot long, id long, label long")
        got = margins.agreement_p(stability.boot_pairs(frame), 1000).first()
        want = stability.stability(frame).agg({"ari": "avg"}).first()[0]
        assert got["observed"] == pytest.approx(want, abs=1e-12) and got["replicates"] == 1000
        p.append(got["p"])
    assert p[0] < 0.002 and p[1] > 0.01


def test_families_are_adjusted_apart(spark):
    rng = random.Random(2)
    rows = [(f, s, rng.choice("ab"), rng.choice("xy")) for f in ("f", "g") for s in range(3) for _ in range(60)]
    got = margins.stratified(spark.createDataFrame(rows, "family string, site long, group string, level string"), "site", ["family"], 1000).collect()
    for f in ("f", "g"):
        ps = sorted(r["p"] for r in got if r["family"] == f)
        qs = sorted(r["q"] for r in got if r["family"] == f)
        want = [min(min(1.0, ps[j] * 3 / (j + 1)) for j in range(i, 3)) for i in range(3)]
        assert qs == pytest.approx(want)


def test_enumeration_helper():
    assert enumerated([3, 1], [4, 4]) == pytest.approx(special.fisher_two_sided(3, 1, 1, 3))
    assert len(list(itertools.islice(compositions(2, [2, 2]), 10))) == 3
