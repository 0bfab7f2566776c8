"""Centroid clustering of integer vectors, with block norms as a screen.

A kept vector is stored once, compressed: its components as 32-bit integers and the Euclidean norm of each segment of SEGMENT
components. By Cauchy-Schwarz the squared distance of a segment is at least the squared difference of the two norms, so the sum
over segments is a lower bound of the distance to a centroid, from a few numbers instead of all components. The centroid of
least bound is measured exactly first; of the others only those whose bound does not exceed that distance are. Distances are
sums of 64-bit integers, so ties are true ties, and bounds are lowered by more than their rounding error.

A round is one pass over the stored table: tasks emit a row a centroid (count and component sums, combined before the shuffle), and the
driver holds K centroids, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, settle, table

DIMENSIONS, K, ROUNDS, SCALE, SEGMENT = 64, 8, 10, 1024, 8
#: Components up to here have exact distances: 64 * (2 * LARGEST) ** 2 is below 2 ** 63.
LARGEST = 1 << 27
SEED = "3:"


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of long) of the vectors of vectors (vec_id, embedding) that have exactly that many components, none null or non-finite.

    Null and shorter or longer vectors are left out, repeated rows stay, other columns are not read. A component of which floor(scale * x) is
    beyond LARGEST raises an error, as its distances need not fit 64 bits.
    """
    own = vectors.select("vec_id", "embedding").filter(F.size("embedding") == dimensions)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) <= LARGEST)
    return own.filter(sound).select("vec_id", F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}"))).alias("v"))


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.reshape(len(v), -1, SEGMENT).astype(np.float64) ** 2).sum(axis=2))


def compressed(vectors: DataFrame) -> DataFrame:
    """quantised vectors as stored: vec_id, packed (components, 32 bits each), norms (of segments, doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column("v").flatten(), np.int64)
            v = flat.reshape(batch.num_rows, -1)
            packed, norms = (pa.array([row.tobytes() for row in m], pa.binary()) for m in (v.astype(np.int32), _norms(v)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), packed, norms], ["vec_id", "packed", "norms"])

    return vectors.mapInArrow(run, "vec_id long, packed binary, norms binary")


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors of smallest lower-case hexadecimal SHA-256 of SEED and the id, in that order; fewer if there are fewer.

    Vectors of one id follow in order of their components; a null id comes after all others.
    """
    mark = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller), the squared distance, and how many exact distances were needed."""
    bound = ((norms[:, None, :] - _norms(centroids)[None]) ** 2).sum(axis=2)
    bound = bound * (1 - 1e-9) - 1  # below the true distance whatever the rounding
    rows = np.arange(len(v))
    best = bound.argmin(axis=1)
    least = ((v - centroids[best]) ** 2).sum(axis=1)
    measured = len(v)
    first = best.copy()
    for c in range(len(centroids)):
        # On a tie a smaller number wins, so a bound that equals the distance is no reason to leave a centroid out.
        at = rows[(bound[:, c] <= least) & (first != c)]
        if len(at):
            d = ((v[at] - centroids[c]) ** 2).sum(axis=1)
            better = (d < least[at]) | ((d == least[at]) & (c < best[at]))
            least[at[better]], best[at[better]] = d[better], c
            measured += len(at)
    return best, least, measured


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    def whole(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1)

    return whole("packed", np.int32).astype(np.int64), whole("norms", np.float64)


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the componentwise floor of the mean of what is nearest to each; one without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            v, norms = _unpacked(batch)
            best, _, _ = nearest(v, norms, centroids)
            n += np.bincount(best, minlength=len(n))
            np.add.at(sums, best, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64()), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    parts = stored.mapInArrow(run, "c int, n long, sums array<long>").select("c", "n", F.posexplode("sums"))
    rows = parts.groupBy("c", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect()  # k times dimensions rows
    out = centroids.copy()
    for r in rows:
        out[r["c"], r["pos"]] = r["total"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector of vectors (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    What is kept, repeated and null ids: see quantised and first_centroids. A vector equally near to two centroids goes to the smaller number.
    Fewer vectors than k give as many centroids; an empty table gives an empty result.
    """
    whole = quantised(vectors)
    stored = settle(compressed(whole))
    centroids = first_centroids(whole, k)
    if not len(centroids):
        return stored.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    for _ in range(rounds):
        centroids = moved(stored, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, least, _ = nearest(*_unpacked(batch), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = settle(stored.mapInArrow(run, "vec_id long, cluster int, distance long"))
    free(stored)
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    rows = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    told = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same, unrolled: one step that assigns and one that moves for each round."""
    sound = f"len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS}"
    steps = [
        f"kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(x::double * {SCALE})::bigint) as v from embeddings where {sound})",
        f"c0 as materialized (select row_number() over (order by sha256('{SEED}' || vec_id), v) - 1 as c, v as m from kept qualify c < {K})",
    ]
    squared = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    near = "select r, vec_id, v, c, d from (select r, vec_id, v, c, {0} as d from kept, c{1}) qualify row_number() over (partition by r order by d, c) = 1"
    for k in range(ROUNDS):
        steps.append(f"n{k} as materialized ({near.format(squared, k)})")
        # Floor of the mean; integer division alone rounds towards zero.
        steps.append(f"m{k} as (select c, list(f order by i) as m from (select c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::bigint // count(*) as f from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from n{k}) group by c, i) group by c)")
        steps.append(f"c{k + 1} as materialized (select c, coalesce(m{k}.m, c{k}.m) as m from c{k} left join m{k} using (c))")
    last = f"last as materialized ({near.format(squared, ROUNDS)})"
    return (
        f"with {', '.join(steps)}, {last} select vec_id, c::integer as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, "
        f"sha256(array_to_string(m, ',')) as centroid_sha256 from last join c{ROUNDS} using (c)"
    )


ORACLE_SQL = _oracle()
