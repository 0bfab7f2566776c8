"""k-means and Gaussian mixtures over any number of rows: the state of a round is a row for each cluster.

A task turns its rows into sums (weights, weighted vectors, weighted outer products), an aggregate adds the sums of all tasks, and the driver
moves k centres or components by them. Rows are read once a round and never gathered; what leaves a task is of the size of the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import free, stored

#: Rounds of oversampling before the start centres are chosen, and candidates of a round for each cluster.
OVERSAMPLING, CANDIDATES = 5, 2
#: Added to the diagonal of a component's covariance.
RIDGE = 1e-6


def clean(points: DataFrame) -> DataFrame:
    """points (id, x) as stored: rows of a null id or vector are left out."""
    return stored(points.filter("id is not null and x is not null").select("id", F.col("x").cast("array<double>").alias("x")))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def summed(points: DataFrame, stats: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of stats (rows to an array of shape), by partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += stats(_matrix(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "v": pa.array(total.ravel()[at])})

    rows = points.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # as many as the state has numbers
    out = np.zeros(int(np.prod(shape)))
    for r in rows:
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres) ** 2).sum(axis=2)


def start_centres(own: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k start centres (k-means||): a few rounds take rows with a chance in proportion to their distance from what is taken, and of these, weighed by
    the rows nearest to them, k are drawn one by one in the same way. The draws are hashes of id and seed, so the start does not depend on how rows are dealt."""
    first = own.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("x").limit(1).collect()
    taken = np.array([r["x"] for r in first], float)
    for turn in range(OVERSAMPLING if len(taken) else 0):
        cost = summed(own, lambda x, c=taken: np.array([_squares(x, c).min(axis=1).sum()]), (1,))[0]
        if cost <= 0:
            break

        def far(batches: Iterator[pa.RecordBatch], c=taken, cost=cost) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chance = CANDIDATES * k * _squares(_matrix(batch), c).min(axis=1) / cost
                yield batch.filter(pa.array(batch.column("u").to_numpy() < chance))

        u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(turn + 1)), 11).cast("double") / float(1 << 53)).alias("u")
        rows = own.select("id", "x", u).mapInArrow(far, "id long, x array<double>, u double").orderBy("id").select("x").collect()  # some CANDIDATES * k
        taken = np.concatenate([taken, np.array([r["x"] for r in rows], float).reshape(-1, taken.shape[1])])
    if len(taken) <= k:
        return taken
    weight = summed(own, lambda x, c=taken: np.bincount(_squares(x, c).argmin(axis=1), minlength=len(c)).astype(float), (len(taken),))
    rng, chosen = np.random.default_rng(seed), [int(weight.argmax())]
    while len(chosen) < k:
        chance = weight * _squares(taken, taken[chosen]).min(axis=1)
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(taken), p=chance / chance.sum())))
    return taken[chosen]


def lloyd(own: DataFrame, centres: np.ndarray, rounds: int = 100, tol: float = 1e-9) -> np.ndarray:
    """The centres after rounds of means, or once none moves further than tol; one without rows stays."""
    for _ in range(rounds if len(centres) else 0):

        def stats(x: np.ndarray, c=centres) -> np.ndarray:
            near = _squares(x, c).argmin(axis=1)
            out = np.zeros((len(c), x.shape[1] + 1))
            np.add.at(out, near, np.c_[np.ones(len(x)), x])
            return out

        sums = summed(own, stats, (len(centres), centres.shape[1] + 1))
        new = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)
        moved, centres = np.abs(new - centres).max(), new
        if moved <= tol:
            break
    return centres


def kmeans(points: DataFrame, k: int, rounds: int = 100, seed: int = 0, start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centres) of points (id, x): distance is squared; ties go to the smaller number. Ids are whole numbers.

    Fewer different rows than k give fewer clusters, an empty table none.
    """
    own = clean(points.withColumn("id", F.col("id").cast("long")))
    centres = start_centres(own, k, seed) if start is None else np.asarray(start, float)
    if not len(centres):
        return own.selectExpr("id", "0 as cluster", "0.0D as distance"), centres
    centres = lloyd(own, centres, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _squares(_matrix(batch), centres)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))], ["id", "cluster", "distance"])

    return own.mapInArrow(run, "id long, cluster int, distance double"), centres


@dataclass
class Mixture:
    """Components of a fitted mixture, and the mean log-likelihood after each round."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    history: list[float] = field(default_factory=list)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, a column for each component."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * ((z**2).sum(axis=0) + len(m) * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
        return out


def _shares(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logs.max(axis=1)
    e = np.exp(logs - top[:, None])
    return e / e.sum(axis=1, keepdims=True), top + np.log(e.sum(axis=1))


def _moved(sums: np.ndarray, offset: np.ndarray) -> Mixture:
    """The mixture of sufficient statistics: of each component its weight, sum and sum of outer products of rows less offset."""
    d = len(offset)
    n = np.maximum(sums[:, 0], 1e-12)
    mean = sums[:, 1 : d + 1] / n[:, None]
    cov = sums[:, d + 1 :].reshape(len(n), d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    return Mixture(n / n.sum(), mean + offset, (cov + cov.transpose(0, 2, 1)) / 2 + RIDGE * np.eye(d))


def gaussian_mixture(points: DataFrame, k: int, rounds: int = 100, tol: float = 1e-6, seed: int = 0, start: np.ndarray | None = None) -> Mixture:
    """Full covariances by expectation maximisation, from the clusters of k-means (or nearest to start); ends once the mean log-likelihood grows by less than tol.

    Rows are taken less the mean of all, so that sums of squares keep their digits. An empty table gives a mixture of no component.
    """
    own = clean(points.withColumn("id", F.col("id").cast("long")))
    centres = lloyd(own, start_centres(own, k, seed)) if start is None else np.asarray(start, float)
    if not len(centres):
        return Mixture(np.empty(0), centres, np.empty((0, 0, 0)))
    d = centres.shape[1]
    whole = summed(own, lambda x: np.r_[len(x), x.sum(axis=0)], (d + 1,))
    offset, size = whole[1:] / whole[0], (len(centres), 1 + d + d * d)

    def gathered(x: np.ndarray, share: np.ndarray) -> np.ndarray:
        y = x - offset
        return np.c_[share.sum(axis=0), share.T @ y, np.einsum("nk,na,nb->kab", share, y, y).reshape(len(centres), -1)]

    mixture = _moved(summed(own, lambda x: gathered(x, np.eye(len(centres))[_squares(x, centres).argmin(axis=1)]), size), offset)
    history: list[float] = []
    for _ in range(rounds):

        def stats(x: np.ndarray, m=mixture) -> np.ndarray:
            share, told = _shares(m.logs(x))
            return np.c_[gathered(x, share), np.full(len(centres), told.sum() / len(centres))]

        sums = summed(own, stats, (size[0], size[1] + 1))
        history.append(float(sums[:, -1].sum() / whole[0]))
        if len(history) > 1 and history[-1] - history[-2] < tol:
            break
        mixture = _moved(sums[:, :-1], offset)
    free(own)
    mixture.history = history
    return mixture


def assign(points: DataFrame, mixture: Mixture) -> DataFrame:
    """(id, cluster, chance): the likeliest component of each row and its share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, _ = _shares(mixture.logs(_matrix(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(share.argmax(axis=1), pa.int32()), pa.array(share.max(axis=1))], ["id", "cluster", "chance"])

    own = points.filter("id is not null and x is not null").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    return own.mapInArrow(run, "id long, cluster int, chance double") if len(mixture.weights) else own.selectExpr("id", "0 as cluster", "1.0D as chance")
