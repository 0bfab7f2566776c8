import numpy as np
import pytest

from loomfold.functions import kernels as k
from loomfold.functions import special
from loomfold.functions.svm import SVM


def blobs(n=60, seed=0):
    rng = np.random.default_rng(seed)
    truth = np.arange(n) % 3
    return np.array([[0, 0], [8, 0], [0, 8]])[truth] + rng.normal(0, 0.5, (n, 2)), truth


def brute_linkage(d, method):
    groups = [[i] for i in range(len(d))]
    heights = []
    f = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        h, a, b = min((f(d[np.ix_(groups[a], groups[b])]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        heights.append(h)
        groups[a] += groups.pop(b)
    return heights


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_heights(method):
    d = k.distances(np.random.default_rng(1).normal(size=(25, 3)))
    assert np.allclose(k.linkage(d, method)[:, 2], brute_linkage(d, method))


def brute_points(x, method):
    """Heights by where each cluster stands: at its mean, or halfway between those it was merged from; weighted by plain halves of distances."""
    at, size, heights = [p for p in x], [1] * len(x), []
    d = {(i, j): np.linalg.norm(x[i] - x[j]) for i in range(len(x)) for j in range(i + 1, len(x))}
    alive = list(range(len(x)))
    while len(alive) > 1:
        h, i, j = min((d[i, j], i, j) for n, i in enumerate(alive) for j in alive[n + 1 :])
        heights.append(h)
        new = len(at)
        at.append((size[i] * at[i] + size[j] * at[j]) / (size[i] + size[j]) if method == "centroid" else (at[i] + at[j]) / 2)
        size.append(size[i] + size[j])
        alive = [k for k in alive if k not in (i, j)]
        for k in alive:
            d[k, new] = (d[min(i, k), max(i, k)] + d[min(j, k), max(j, k)]) / 2 if method == "weighted" else np.linalg.norm(at[k] - at[new])
        alive.append(new)
    return heights


@pytest.mark.parametrize("method", ["weighted", "centroid", "median"])
def test_linkage_heights_by_position(method):
    x = np.random.default_rng(4).normal(size=(24, 3))
    assert np.allclose(k.linkage(k.distances(x), method)[:, 2], brute_points(x, method))


def test_linkages_differ_where_they_should():
    """A chain beside a ball: single linkage keeps the chain whole, complete and Ward's cut it."""
    chain = np.c_[np.arange(30) * 1.0, np.zeros(30)]
    ball = np.array([[14.0, 6.0]]) + np.random.default_rng(5).normal(0, 0.2, (30, 2))
    d, truth = k.distances(np.r_[chain, ball]), np.repeat([0, 1], 30)
    assert k.ari(k.cut(k.linkage(d, "single"), 60, 2), truth) == 1
    assert all(k.ari(k.cut(k.linkage(d, m), 60, 2), truth) < 0.9 for m in ("complete", "ward"))


def test_ward_height_is_the_rise_of_the_sum_of_squares():
    x = np.random.default_rng(2).normal(size=(20, 2))
    merges = k.linkage(k.distances(x), "ward")
    total = ((x - x.mean(axis=0)) ** 2).sum()
    assert np.isclose((merges[:, 2] ** 2 / 2).sum(), total)


@pytest.mark.parametrize("method", k.LINKAGES)
def test_linkages_find_blobs(method):
    x, truth = blobs()
    assert k.ari(k.cut(k.linkage(k.distances(x), method), len(x), 3), truth) == 1


def test_other_clusterers_find_blobs():
    x, truth = blobs()
    found = [k.kmeans(x, 3), k.gaussian_mixture(x, 3), k.spectral(k.knn_affinity(x), 3), k.mean_shift(x), k.ensemble(x, 3), k.ensemble_of_distances(k.fused([truth, truth]), 3)]
    assert [k.ari(f, truth) for f in found] == [1] * len(found)


def test_cophenetic_of_single_linkage_is_ultrametric():
    d = k.distances(np.random.default_rng(3).normal(size=(15, 2)))
    c = k.cophenetic(k.linkage(d, "single"), 15)
    assert all(c[i, j] <= max(c[i, m], c[m, j]) + 1e-12 for i in range(15) for j in range(15) for m in range(15))


def test_fusion_invariants():
    rng = np.random.default_rng(4)
    labels = [rng.integers(0, 3, 30) for _ in range(4)]
    for method, top in (("agreement", 1), ("disagreement", 4), ("consensus", 1)):
        d = k.fused(labels, method)
        assert (d == d.T).all() and (np.diag(d) == 0).all() and d.min() >= 0 and d.max() <= top


def test_mds_restores_distances():
    x = np.random.default_rng(5).normal(size=(20, 3))
    assert np.allclose(k.distances(k.mds(k.distances(x))), k.distances(x), atol=1e-6)


def test_min_cluster_size_leaves_no_small_cluster():
    x, truth = blobs()
    labels = truth.copy()
    labels[:2] = [7, 8]
    moved = k.min_cluster_size(k.distances(x), labels, 5)
    assert k.ari(moved, truth) == 1
    assert (k.min_cluster_size(k.distances(x), labels, 1000) == labels).all()


def test_distribution_tails():
    # Published tables.
    assert np.isclose(special.t_two_sided(2.228, 10), 0.05, atol=2e-4)
    assert np.isclose(special.chi2_upper(3.841, 1), 0.05, atol=2e-4)
    assert np.isclose(special.chi2_upper(18.307, 10), 0.05, atol=2e-4)
    assert np.isclose(special.f_upper(4.103, 2, 10), 0.05, atol=2e-4)
    assert np.isclose(special.fisher_two_sided(3, 1, 1, 3), 0.4857, atol=1e-4)
    assert np.isclose(special.normal_upper(1.96), 0.025, atol=1e-4)
    assert special.betainc(2, 3, 0) == 0 and special.betainc(2, 3, 1) == 1


@pytest.mark.parametrize("kind", ["linear", "rbf", "poly"])
def test_svm_separates(kind):
    x, truth = blobs()
    model = SVM(kind=kind).fit(x, truth)
    assert (model.predict(x) == truth).mean() > 0.95
    assert np.allclose(model.probabilities(x).sum(axis=1), 1)
    assert len(model.importance(x, truth)) == 2


def test_svm_holds_no_matrix_of_its_rows(monkeypatch):
    """Before, fit made the kernel of all rows with all rows, and the score all pairs of two classes."""
    from loomfold.functions import svm

    shapes, real = [], svm.kernel
    monkeypatch.setattr(svm, "kernel", lambda x, y, *more: shapes.append((len(x), len(y))) or real(x, y, *more))
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1.0, size=(200, 2)) for c in (0, 3, 6)])
    y = np.repeat([0, 1, 2], 200)
    for kind in ("linear", "rbf", "poly"):
        model = svm.SVM(kind=kind, rounds=5).fit(x, y)
        p = model.probabilities(x)
        told = svm.scores(y, model.predict(x), p, model.classes)
        pairs = [((p[y == c, k][:, None] > p[y != c, k]).mean() + (p[y == c, k][:, None] == p[y != c, k]).mean() / 2) for k, c in enumerate(model.classes)]
        assert np.isclose(told["auc"], np.mean(pairs)) and np.allclose(svm.diagonal(x, kind, model.g), np.diag(real(x, x, kind, model.g)))
    assert max(a for a, _ in shapes) <= svm.STRIP
