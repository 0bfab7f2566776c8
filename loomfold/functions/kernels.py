"""Dense clustering kernels on numpy, for groups of a few thousand rows inside one task.

All are deterministic: random starts come from a seed, and ties go to the smallest index.
"""

from __future__ import annotations

from math import sqrt

import numpy as np

LINKAGES = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def distances(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    square = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(0, square[:, None] + square - 2 * x @ x.T))
    np.fill_diagonal(d, 0)
    return d


def linkage(d: np.ndarray, method: str = "average", sizes: np.ndarray | None = None) -> np.ndarray:
    """Merges (a, b, height, size) of agglomerative clustering; clusters are numbered n, n + 1, ... as they form.

    Ward's method is for Euclidean distances; on others take average. sizes, if given, are of clusters to begin with.
    """
    n = len(d)
    squared = method in ("centroid", "median", "ward")
    m = np.array(d, float) ** 2 if squared else np.array(d, float)
    np.fill_diagonal(m, np.inf)
    size, name, alive, out = np.ones(n) if sizes is None else np.array(sizes, float), np.arange(n), np.ones(n, bool), []
    near = m.argmin(axis=1) if n > 1 else np.zeros(n, int)
    least = m[np.arange(n), near] if n > 1 else np.full(n, np.inf)
    for step in range(n - 1):
        i = int(np.where(alive, least, np.inf).argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        height = m[i, j]
        a, b = size[i], size[j]
        di, dj = m[i], m[j]
        if method == "single":
            new = np.minimum(di, dj)
        elif method == "complete":
            new = np.maximum(di, dj)
        elif method == "average":
            new = (a * di + b * dj) / (a + b)
        elif method == "weighted":
            new = (di + dj) / 2
        elif method == "centroid":
            new = (a * di + b * dj) / (a + b) - a * b * height / (a + b) ** 2
        elif method == "median":
            new = (di + dj) / 2 - height / 4
        elif method == "ward":
            new = ((a + size) * di + (b + size) * dj - size * height) / (a + b + size)
        else:
            raise ValueError(f"no linkage {method}")
        out.append((*sorted((name[i], name[j])), sqrt(max(0.0, height)) if squared else height, a + b))
        new = np.where(alive, new, np.inf)
        new[[i, j]] = np.inf
        m[i], m[:, i] = new, new
        m[j], m[:, j] = np.inf, np.inf
        alive[j], size[i], name[i] = False, a + b, n + step
        for k in np.flatnonzero(alive & ((near == i) | (near == j) | (new < least))):
            near[k] = m[k].argmin()
            least[k] = m[k, near[k]]
        near[i] = m[i].argmin()
        least[i] = m[i, near[i]]
    return np.array(out).reshape(-1, 4)


def centre_linkage(x: np.ndarray, method: str = "centroid", sizes: np.ndarray | None = None) -> np.ndarray:
    """Merges of centroid or median linkage of points, by centres: time is quadratic, memory linear in the points. sizes, if given, are of the points.

    A row whose nearest centre moved away keeps its least distance as a lower bound, and is searched again when that is the least of all.
    """
    c = np.array(x, float).T.copy()
    n = c.shape[1]
    size, name, out = np.ones(n) if sizes is None else np.array(sizes, float), np.arange(n), []
    near, least, stale = np.zeros(n, int), np.full(n, np.inf), np.zeros(n, bool)

    def search(i: int) -> None:
        d = ((c - c[:, i, None]) ** 2).sum(axis=0)
        d[i] = np.inf
        near[i] = d.argmin()
        least[i], stale[i] = d[near[i]], False

    for i in range(n if n > 1 else 0):
        search(i)
    left = n
    for step in range(n - 1):
        i = int(least.argmin())
        while stale[i]:
            search(i)
            i = int(least.argmin())
        i, j, height = min(i, near[i]), max(i, near[i]), least[i]
        a, b = size[i], size[j]
        out.append((*sorted((name[i], name[j])), sqrt(height), a + b))
        c[:, i] = (a * c[:, i] + b * c[:, j]) / (a + b) if method == "centroid" else (c[:, i] + c[:, j]) / 2
        c[:, j], size[i], name[i], least[j] = np.inf, a + b, n + step, np.inf
        left -= 1
        d = ((c - c[:, i, None]) ** 2).sum(axis=0)
        d[i] = np.inf
        stale |= (near == i) | (near == j)
        closer = (d < least) & np.isfinite(d)
        near[closer], least[closer], stale[closer] = i, d[closer], False
        near[i] = d.argmin()
        least[i], stale[i], stale[j] = d[near[i]], False, False
        if 2 * left < len(size) and left > 64:
            kept = np.flatnonzero(np.isfinite(c[0]))
            at = np.full(len(size), -1)
            at[kept] = np.arange(len(kept))
            c, size, name, least = c[:, kept].copy(), size[kept], name[kept], least[kept]
            stale, near = stale[kept] | (at[near[kept]] < 0), np.maximum(at[near[kept]], 0)
    return np.array(out).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, k: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels from 0 in the order of first members: k clusters, or those formed up to a height."""
    root = list(range(2 * n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for step, (a, b, h, _) in enumerate(merges):
        if step >= n - k if k is not None else h > (height or 0):
            break
        root[find(int(a))] = root[find(int(b))] = n + step
    kinds: dict[int, int] = {}
    return np.array([kinds.setdefault(find(i), len(kinds)) for i in range(n)], int)


def cophenetic(merges: np.ndarray, n: int) -> np.ndarray:
    """The height at which each pair is joined."""
    members, out = {i: [i] for i in range(n)}, np.zeros((n, n))
    for step, (a, b, h, _) in enumerate(merges):
        left, right = members.pop(int(a)), members.pop(int(b))
        out[np.ix_(left, right)] = h
        out[np.ix_(right, left)] = h
        members[n + step] = left + right
    return out


def kmeans(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """k-means++ of the best of several starts."""
    x, rng = np.asarray(x, float), np.random.default_rng(seed)
    k, best = min(k, len(x)), (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        centres = [x[rng.integers(len(x))]]
        for _ in range(k - 1):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        centres = np.array(centres)
        for _ in range(rounds):
            d = ((x[:, None] - centres) ** 2).sum(axis=2)
            label = d.argmin(axis=1)
            new = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        cost = d[np.arange(len(x)), label].sum()
        if cost < best[0] - 1e-12:
            best = (cost, label)
    return best[1]


def gaussian_mixture(x: np.ndarray, k: int, seed: int = 0, rounds: int = 200, ridge: float = 1e-6) -> np.ndarray:
    """Full covariances, from k-means, by expectation maximisation."""
    x = np.asarray(x, float)
    n, p = x.shape
    share = np.eye(min(k, n))[kmeans(x, k, seed)]
    before = -np.inf
    for _ in range(rounds):
        weight = share.sum(axis=0) + 1e-10
        means, logs = share.T @ x / weight[:, None], []
        for c in range(len(weight)):
            centred = x - means[c]
            cov = (share[:, c, None] * centred).T @ centred / weight[c] + ridge * np.eye(p)
            sign, det = np.linalg.slogdet(cov)
            logs.append(np.log(weight[c] / n) - 0.5 * (p * np.log(2 * np.pi) + det + (centred * np.linalg.solve(cov, centred.T).T).sum(axis=1)))
        logs = np.array(logs).T
        top = logs.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        share = np.exp(logs - total)
        if abs(total.sum() - before) < 1e-6 * abs(before):
            break
        before = total.sum()
    return share.argmax(axis=1)


def spectral(affinity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means on the leading vectors of the normalised Laplacian; fewer rows than clusters are clusters of one."""
    n = len(affinity)
    if n < k:
        return np.arange(n)
    a = np.array(affinity, float)
    np.fill_diagonal(a, 0)
    scale = 1 / np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
    _, vectors = np.linalg.eigh(np.eye(n) - scale[:, None] * a * scale)
    rows = vectors[:, :k]
    return kmeans(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12), k, seed)


def knn_affinity(x: np.ndarray, neighbours: int = 10) -> np.ndarray:
    """Symmetric nearest-neighbour graph; where it falls apart, a Gaussian kernel of the median distance instead."""
    d = distances(x)
    n = len(d)
    neighbours = min(neighbours, max(2, n // 5))  # of few rows, not all the others
    a = np.zeros((n, n))
    for i, js in enumerate(d.argsort(axis=1, kind="stable")[:, : neighbours + 1]):
        a[i, js] = 1
    a = np.maximum(a, a.T)
    seen, todo = {0}, [0]
    while todo:
        for j in np.flatnonzero(a[todo.pop()]).tolist():
            if j not in seen:
                seen.add(j)
                todo.append(j)
    if len(seen) == n:
        return a
    middle = np.median(d[np.triu_indices(n, 1)]) if n > 1 else 1
    return np.exp(-(d**2) / (2 * max(middle, 1e-12) ** 2))


def mean_shift(x: np.ndarray, quantile: float = 0.3, rounds: int = 100) -> np.ndarray:
    """Flat kernel; the bandwidth is the mean distance to the neighbour at the quantile."""
    x, d = np.asarray(x, float), distances(x)
    width = max(1e-9, np.sort(d, axis=1)[:, min(len(x) - 1, max(1, int(len(x) * quantile)))].mean())
    modes = x.copy()
    for _ in range(rounds):
        inside = ((modes[:, None] - x) ** 2).sum(axis=2) <= width**2
        new = inside @ x / np.maximum(inside.sum(axis=1, keepdims=True), 1)
        if np.abs(new - modes).max() < 1e-3 * width:
            break
        modes = new
    return cut(linkage(distances(modes), "single"), len(x), height=width)


def min_cluster_size(d: np.ndarray, labels: np.ndarray, least: int) -> np.ndarray:
    """Members of small clusters go to the large cluster of least mean distance; without a large one nothing moves."""
    kinds, counts = np.unique(labels, return_counts=True)
    large = kinds[counts >= least]
    out = labels.copy()
    if len(large):
        for i in np.flatnonzero(~np.isin(labels, large)):
            out[i] = large[np.argmin([d[i, labels == c].mean() for c in large])]
    return out


def together(x: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(distances, how many of the four members without a linkage put two rows in one cluster): what every linkage of an ensemble starts from."""
    x = np.asarray(x, float)
    d, k = distances(x), min(k, len(x))
    members = [spectral(knn_affinity(x), k, seed), gaussian_mixture(x, k, seed), kmeans(x, k, seed), mean_shift(x)]
    return d, np.sum([m[:, None] == m for m in members], axis=0)


def cut_together(d: np.ndarray, same: np.ndarray, k: int, method: str = "average", least: int = 0) -> np.ndarray:
    """The fifth member by the linkage, and the co-association of all five cut by the same linkage (Ward's too, on these distances)."""
    k = min(k, len(d))
    own = cut(linkage(d, method), len(d), k)
    labels = cut(linkage(1 - (same + (own[:, None] == own)) / 5, method), len(d), k)
    return min_cluster_size(d, labels, least)


def ensemble(x: np.ndarray, k: int, method: str = "average", seed: int = 0, least: int = 0) -> np.ndarray:
    """Five clusterers of raw rows, their co-association, and its linkage cut at k."""
    return cut_together(*together(x, k, seed), k, method, least)


def ensemble_of_distances(d: np.ndarray, k: int, method: str = "average", seed: int = 0, least: int = 0) -> np.ndarray:
    """The same for fused distances: a hierarchical and a spectral member, both told k."""
    method = "average" if method == "ward" else method
    k = min(k, len(d))
    top = d.max() if d.size and d.max() > 0 else 1
    members = [cut(linkage(d, method), len(d), k), spectral(1 - d / top, k, seed)]
    together = np.mean([m[:, None] == m for m in members], axis=0)
    return min_cluster_size(d, cut(linkage(1 - together + 1e-6 * d / top, method), len(d), k), least)


def fused(labels: list[np.ndarray], method: str = "agreement") -> np.ndarray:
    same = np.array([m[:, None] == m for m in labels])
    if method == "agreement":
        return 1 - same.mean(axis=0)
    if method == "disagreement":
        return (~same).sum(axis=0).astype(float)
    if method == "consensus":
        return 1.0 - same.all(axis=0)
    raise ValueError(f"no fusion {method}")


def mds(d: np.ndarray, dims: int = 10) -> np.ndarray:
    """Classical scaling to at most dims positive dimensions."""
    n = len(d)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    order = np.argsort(values)[::-1][:dims]
    order = order[values[order] > 1e-9]
    return vectors[:, order] * np.sqrt(values[order]) if len(order) else np.zeros((n, 1))


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    own = np.zeros(len(d))
    means = np.array([d[:, labels == c].mean(axis=1) for c in kinds])
    for k, c in enumerate(kinds):
        at = labels == c
        n = at.sum()
        if n > 1:
            a = means[k, at] * n / (n - 1)
            b = np.delete(means, k, axis=0)[:, at].min(axis=0)
            own[at] = (b - a) / np.maximum(np.maximum(a, b), 1e-300)
    return float(own.mean())


def quality(x: np.ndarray, labels: np.ndarray, d: np.ndarray | None = None) -> float:
    """Mean of silhouette, Calinski-Harabasz and Davies-Bouldin, each on 0..1; one cluster goes by Hopkins."""
    x, kinds, n = np.asarray(x, float), np.unique(labels), len(labels)
    if len(kinds) < 2:
        return hopkins_quality(x)
    centres, sizes = np.array([x[labels == c].mean(axis=0) for c in kinds]), np.array([(labels == c).sum() for c in kinds])
    within = sum(((x[labels == c] - centres[k]) ** 2).sum() for k, c in enumerate(kinds))
    between = (sizes[:, None] * (centres - x.mean(axis=0)) ** 2).sum()
    ch = between * (n - len(kinds)) / (within * (len(kinds) - 1)) if within > 0 else np.inf
    spread = np.array([np.linalg.norm(x[labels == c] - centres[k], axis=1).mean() for k, c in enumerate(kinds)])
    apart = distances(centres)
    np.fill_diagonal(apart, np.inf)
    db = ((spread[:, None] + spread) / np.maximum(apart, 1e-300)).max(axis=1).mean()
    return float((silhouette(distances(x) if d is None else d, labels) / 2 + 0.5 + (ch / (ch + 1) if np.isfinite(ch) else 1) + 1 / (1 + db)) / 3)


def hopkins_quality(x: np.ndarray, seed: int = 0) -> float:
    """1 - U / (U + W): distances to the nearest row, to the power of the dimension, from uniform points and from rows (their second nearest)."""
    x, rng = np.asarray(x, float), np.random.default_rng(seed)
    n, p = x.shape
    m = min(50, n // 2)
    if n < 3:
        return 1.0
    points = rng.uniform(x.min(axis=0), x.max(axis=0), (m, p))
    u = np.sqrt(((points[:, None] - x) ** 2).sum(axis=2)).min(axis=1) ** p
    d = distances(x[rng.choice(n, m, replace=False)][:, :]) if m == n else np.sqrt(((x[rng.choice(n, m, replace=False)][:, None] - x) ** 2).sum(axis=2))
    w = np.sort(d, axis=1)[:, 1] ** p
    return float(1 - u.sum() / (u.sum() + w.sum() + 1e-12))


def ari(a: np.ndarray, b: np.ndarray) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    c = lambda t: (t * (t - 1) / 2).sum()
    expected, top = c(table.sum(axis=1)) * c(table.sum(axis=0)) / c(np.array([len(a)])), (c(table.sum(axis=1)) + c(table.sum(axis=0))) / 2
    return float((c(table) - expected) / (top - expected)) if top != expected else 1.0
