"""k-means, mixtures and the dip against plain versions."""

import itertools

import numpy as np
import pytest

from loomfold.operators import mixtures, unimodal


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, x array<double>")


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(c, s, (60, 2)) for c, s in (((0, 0), 1.0), ((9, 0), 0.5), ((0, 14), 2.0))]) + 1000.0


def plain_em(x, centres, rounds):
    """Full covariances, from the rows nearest to the centres."""
    share = np.eye(len(centres))[((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)]
    history = []
    for turn in range(rounds + 1):
        n = share.sum(axis=0)
        means = share.T @ x / n[:, None]
        cov = [((x - m).T * share[:, k]) @ (x - m) / n[k] + mixtures.RIDGE * np.eye(2) for k, m in enumerate(means)]
        logs = np.stack([np.log(n[k] / n.sum()) - 0.5 * np.einsum("na,ab,nb->n", x - m, np.linalg.inv(c), x - m) - 0.5 * np.log(np.linalg.det(2 * np.pi * c)) for k, (m, c) in enumerate(zip(means, cov))], axis=1)
        total = np.log(np.exp(logs).sum(axis=1))
        if turn == rounds:
            return means, cov, history
        history.append(total.mean())
        share = np.exp(logs - total[:, None])


def test_mixture_equals_plain_em(spark, clouds):
    start = np.array([[1000.0, 1003.0], [1006.0, 1001.0], [1001.0, 1009.0]])
    got = mixtures.gaussian_mixture(frame(spark, clouds).repartition(5), 3, rounds=6, tol=-1.0, start=start)
    means, cov, history = plain_em(clouds, start, 6)
    assert got.means == pytest.approx(means, abs=1e-6) and got.covariances == pytest.approx(np.array(cov), abs=1e-5)
    assert got.history == pytest.approx(history, abs=1e-8) and all(b >= a - 1e-12 for a, b in itertools.pairwise(got.history))


def test_clouds_are_found_however_rows_are_dealt(spark, clouds):
    x = frame(spark, clouds)
    for own in (x, x.repartition(7)):
        found, centres = mixtures.kmeans(own, 3)
        labels = {r["id"]: r["cluster"] for r in found.collect()}
        assert len({(k // 60, c) for k, c in labels.items()}) == 3
    fitted = mixtures.gaussian_mixture(x, 3)
    assert sorted(np.sqrt(np.linalg.det(c)) for c in fitted.covariances) == pytest.approx([0.25, 1.0, 4.0], rel=0.4)
    rows = mixtures.assign(x, fitted).collect()
    assert len({(r["id"] // 60, r["cluster"]) for r in rows}) == 3 and min(r["chance"] for r in rows) > 0.5


def test_lloyd_equals_plain_rounds(spark):
    x = np.random.default_rng(2).normal(size=(80, 3))
    centres = x[:4].copy()
    got = mixtures.lloyd(mixtures.clean(frame(spark, x)), centres, rounds=5)
    for _ in range(5):
        near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(4)])
    assert got == pytest.approx(centres)


def test_few_and_repeated_rows(spark):
    same = frame(spark, [(1.0, 2.0)] * 9)
    found, centres = mixtures.kmeans(same, 3)
    assert len(centres) == 1 and {(r["cluster"], r["distance"]) for r in found.collect()} == {(0, 0.0)}
    assert len(mixtures.gaussian_mixture(same, 2).weights) == 1
    none = same.limit(0)
    assert mixtures.kmeans(none, 2)[0].count() == 0 and mixtures.assign(none, mixtures.gaussian_mixture(none, 2)).count() == 0
    rows = spark.createDataFrame([(1, [0.0]), (None, [1.0]), (2, None), (3, [9.0])], "id long, x array<double>").selectExpr("*", "1 as cluster", "2 as u")
    assert sorted(r["id"] for r in mixtures.kmeans(rows, 2)[0].collect()) == [1, 3]


def plain_dip(x, n):
    """By bisection: the least d at which some mode has, within d of the distribution, a convex part before and a concave one after it that do not fall."""
    after = np.cumsum(n) / np.sum(n)
    before = after - np.array(n) / np.sum(n)

    def fits(d, m):
        left = [(x[i], after[i] - d, before[i] + d) for i in range(m)] + [(x[m], before[m] - d, before[m] + d)]
        right = [(x[m], after[m] - d, after[m] + d)] + [(x[i], after[i] - d, before[i] + d) for i in range(m + 1, len(x))]
        if any(a[1] > a[2] + 1e-12 for a in left + right):
            return False
        at = lambda a, b, c, k: a[k] + (c[k] - a[k]) * (b[0] - a[0]) / (c[0] - a[0])
        if any(b[1] > at(a, b, c, 2) + 1e-12 for a, b, c in itertools.combinations(left, 3)) or any(b[2] < at(a, b, c, 1) - 1e-12 for a, b, c in itertools.combinations(right, 3)):
            return False
        line = lambda a, u, b, v: u + (v - u) * (x[m] - a[0]) / (b[0] - a[0])
        least = max([left[-1][1], *(line(a, a[2], b, b[1]) for a, b in itertools.combinations(left[:-1], 2))])
        most = min([right[0][2], *(line(b, b[1], a, a[2]) for a, b in itertools.combinations(right[1:], 2))])
        return least <= most + 1e-12

    low, high = 0.0, 0.5
    for _ in range(30):
        d = (low + high) / 2
        low, high = (low, d) if any(fits(d, m) for m in range(len(x))) else (d, high)
    return high


@pytest.mark.parametrize("seed", range(30))
def test_dip_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.random(rng.integers(2, 9)))
    n = rng.integers(1, 5, len(x)) if seed % 2 else np.ones(len(x))
    assert unimodal.dip(x, n) == pytest.approx(plain_dip(x, n), abs=1e-6)


def test_dip_of_nothing():
    assert unimodal.dip(np.array([])) == unimodal.dip(np.array([3.0])) == 0.0


def test_distances_are_counted_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(60, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))[np.triu_indices(60, 1)]
    box = np.sqrt((np.ptp(x, axis=0) ** 2).sum())
    want = dict(zip(*np.unique((d / (box / 256)).astype(int), return_counts=True)))
    monkeypatch.setattr(unimodal, "blocked", lambda points, f=unimodal.blocked: _small(monkeypatch, f, points))
    got = {round(r["distance"] / (box / 256)): r["n"] for r in unimodal.distance_counts(frame(spark, x), 256).collect()}
    assert got == want


def _small(monkeypatch, blocked, points):
    from loomfold.operators import trees

    monkeypatch.setattr(trees, "BLOCK", 13)
    return blocked(points)


def test_one_mode_or_two(spark):
    rng = np.random.default_rng(3)
    one = unimodal.distance_dip(frame(spark, rng.random((70, 1))), samples=60).first()
    two = unimodal.distance_dip(frame(spark, np.concatenate([rng.random((40, 1)), rng.random((40, 1)) + 30])), samples=60).first()
    assert one["n"] == 70 * 69 / 2 and one["p"] > 0.05 and two["p"] < 0.02 and two["dip"] > one["dip"]
    assert tuple(unimodal.distance_dip(frame(spark, [(1.0,)])).first()) == (0, 0.0, 1.0)
