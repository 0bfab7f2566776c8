"""Agglomerative clustering without a matrix of distances: merges as edges between smallest ids, cut as a spanning tree is.

Complete, average, weighted and Ward linkage are reducible: a merge brings no cluster nearer than the nearer of its parts was. So clusters that are nearest to each other
may merge in any order, and a round merges all such pairs. What a round compares is made from the points, a pair of blocks a task: greatest distances, sums of distances (weighted linkage:
each point weighs a half for every merge it went through; average: one over its cluster's size), or centres and sizes. A cluster is in one block.
No distance but Ward's is less than that of the centres, or more than that and both radii: so clusters whose centres are too far apart for the nearest are not compared, unless nearly all would be. The clusters that rounds leave, at most LAST, are
joined by one task. Equal points are one from the start, but for average linkage. Single linkage is the minimum spanning tree. Centroid and median linkage are not reducible: their merges stand in one order, each over all centres, in one task whose memory is linear in the points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, repeats
from ..sources.store import free, stored
from . import trees

#: Clusters that one task joins, and whose centres it compares; points of a block on average, and of a part of a cluster.
LAST, CENTRES, BLOCK, STRIP, PART = 1024, 8192, 2048, 256, 128
EDGE = "u long, v long, height double"


def _between(x: np.ndarray, y: np.ndarray, squared: bool = False) -> np.ndarray:
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d += (x[:, c][:, None] - y[:, c]) ** 2
    return d if squared else np.sqrt(d, out=d)


def cluster_distances(code: np.ndarray, x: np.ndarray, weight: np.ndarray, other: tuple, method: str) -> np.ndarray:
    """The distances between the clusters of two blocks, each given as sorted codes from 0, points and weights; Ward's are of centres with sizes, squared."""
    there, y, heavy = other
    if method == "ward":
        return _between(x, y, True) * (2 * weight[:, None] * heavy / (weight[:, None] + heavy))
    out = np.zeros((code[-1] + 1, there[-1] + 1))
    starts = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
    for k in range(0, len(x), STRIP):
        d = _between(x[k : k + STRIP], y)
        if method == "complete":
            np.maximum.at(out, code[k : k + STRIP], np.maximum.reduceat(d, starts, axis=1))
        else:
            d *= weight[k : k + STRIP, None] * heavy
            np.add.at(out, code[k : k + STRIP], np.add.reduceat(d, starts, axis=1))
    return out


def _side(table: pa.Table, at: np.ndarray) -> tuple:
    comp, flat = table.column("comp").to_numpy()[at], table.column("x").combine_chunks()
    x, weight = np.asarray(flat.flatten(), float).reshape(len(flat), -1)[at], table.column("weight").to_numpy()[at]
    order = np.argsort(comp, kind="stable")
    names, code = np.unique(comp[order], return_inverse=True)
    return names, (code, x[order], weight[order])


def _nearest(method: str):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        first = block == block.min()
        names, own = _side(table, np.flatnonzero(first))
        others, other = (names, own) if first.all() else _side(table, np.flatnonzero(~first))
        m = cluster_distances(*own, other, method)
        if first.all():
            np.fill_diagonal(m, np.inf)
        out = []
        for mine, theirs, d in ((names, others, m), (others, names, m.T)):
            near = d.argmin(axis=1)  # of equally near ones the smallest name, as names are sorted
            height = d[np.arange(len(d)), near]
            some = np.isfinite(height)
            u, v = mine[some], theirs[near[some]]
            out.append(pa.table({"comp": u, "height": height[some], "u": np.minimum(u, v), "v": np.maximum(u, v)}))
        return pa.concat_tables(out)

    return run


def _every(method: str):
    """All distances between the clusters of two blocks (a <= b); that of a cluster with itself is its size."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        first = block == block.min()
        names, own = _side(table, np.flatnonzero(first))
        others, other = (names, own) if first.all() else _side(table, np.flatnonzero(~first))
        m = cluster_distances(*own, other, method)
        if first.all():
            np.fill_diagonal(m, own[2] if method == "ward" else np.bincount(own[0]))
        a, b = np.repeat(names, len(others)), np.tile(others, len(names))
        kept = a <= b if first.all() else np.ones(len(a), bool)
        return pa.table({"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept], "d": m.ravel()[kept]})

    return run


def _last(method: str):
    def run(own: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(own["a"].to_numpy())
        i, j = np.searchsorted(names, own["a"]), np.searchsorted(names, own["b"])
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = own["d"]
        size = m.diagonal().copy()
        np.fill_diagonal(m, 0)
        return _edges(kernels.linkage(np.sqrt(m) if method == "ward" else m, method, size), names)

    return run


def _centres(method: str):
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        edges = _edges(kernels.centre_linkage(np.array(own["x"].tolist(), float), method, own["n"].to_numpy(float)), own["id"].to_numpy())
        return edges.assign(reach=edges["height"].cummax(), step=np.arange(len(edges), dtype=float))

    return run


def _edges(merges: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """Merges between clusters as edges between their smallest names."""
    least, out = list(names), []
    for a, b, height, _ in merges:
        u, v = sorted((least[int(a)], least[int(b)]))
        least.append(u)
        out.append((u, v, height))
    return pd.DataFrame(out, columns=["u", "v", "height"]).astype({"u": "int64", "v": "int64", "height": "float64"})


def merge_tree(points: DataFrame, method: str) -> DataFrame:
    """(u, v, height) of the merges of a linkage of points (id, x), by the smallest ids of what merges, stored; n - 1 rows. Centroid and median heights may fall: they also have the step and the greatest height up to it (reach).

    Ids are whole numbers and must not repeat; a null id or vector is left out, vectors have one length.
    """
    own = points.filter("id is not null and x is not null").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    if method == "single":
        return trees.spanning_tree(own)
    tree = None
    if method != "average":  # whose weights need the sizes of single points
        own, tree = trees.collapsed(own)
    if method in ("centroid", "median"):
        found = own.groupBy(F.lit(0).alias("_all")).applyInPandas(_centres(method), f"{EDGE}, reach double, step double")  # memory is linear in the points
        return stored(tree.withColumn("reach", F.lit(0.0)).withColumn("step", F.lit(-1.0)).unionByName(found))
    state = stored(own.select(F.col("id").alias("comp"), "x", (F.col("n").cast("double") if method == "ward" else F.lit(1.0)).alias("weight")))
    clusters = many = state.count()
    while clusters > LAST:
        near = None if method == "ward" or many <= 4 * BLOCK else _apart(state, method)
        if near is None:
            near = _met(state, _nearest(method), "comp long, height double, u long, v long")
        least = near.groupBy("comp").agg(F.min(F.struct("height", "u", "v")).alias("e"))
        # The edges that both of their ends choose; the least of all is one.
        pairs = stored(least.groupBy("e.u", "e.v", "e.height").agg(F.count(F.lit(1)).alias("ends")).filter("ends = 2").select("u", "v", "height"))
        after = stored(_merged(state, pairs, method))
        free(state)
        state, tree = after, pairs if tree is None else tree.unionByName(pairs)
        clusters -= pairs.count()
    if method == "ward" and tree is not None:
        tree = tree.withColumn("height", F.sqrt("height"))
    last = _met(state, _every(method), "a long, b long, d double").groupBy(F.lit(0).alias("_all")).applyInPandas(_last(method), EDGE)  # at most LAST clusters
    out = stored(last if tree is None else tree.unionByName(last))
    free(state)
    return out


def _bounds(table: pa.Table) -> pa.Table:
    """(comp, reach): of two blocks of centres, the least that a cluster's nearest can be away at most."""
    own, other, one = _centred(table)
    ahead, back = np.full(len(own[0]), np.inf), np.full(len(other[0]), np.inf)
    for k in range(0, len(own[0]), STRIP):
        at = slice(k, k + STRIP)
        d = repeats.between(own[1][at], other[1]) + own[2][at, None] + other[2]
        if one:
            d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
        ahead[at], back = d.min(axis=1), np.minimum(back, d.min(axis=0))
    return pa.table({"comp": own[0], "reach": ahead}) if one else pa.table({"comp": np.r_[own[0], other[0]], "reach": np.r_[ahead, back]})


def _candidates(table: pa.Table) -> pa.Table:
    """(a, b), a < b: clusters of two blocks whose centres are near enough for one to be the other's nearest."""
    own, other, one = _centred(table)
    out = [np.empty((0, 2), np.int64)]
    for k in range(0, len(own[0]), STRIP):
        at = slice(k, k + STRIP)
        i, j = np.nonzero(repeats.between(own[1][at], other[1]) <= np.maximum(own[3][at, None], other[3]) * (1 + 1e-9))
        a, b = own[0][at][i], other[0][j]
        out.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)])[a < b if one else slice(None)])
    found = np.concatenate(out)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _few_candidates(table: pa.Table) -> pa.Table:
    """_candidates within the one block of a table, whose reaches it makes."""
    return _candidates(table.drop_columns(["reach"]).append_column("reach", _bounds(table).column("reach")))


def _centred(table: pa.Table) -> tuple[tuple, tuple, bool]:
    """Names, centres, radii and reaches of the two blocks of a table, and whether they are one."""
    block = table.column("block").to_numpy()
    first, flat = block == block.min(), table.column("x").combine_chunks()
    columns = table.column("comp").to_numpy(), np.asarray(flat.flatten(), float).reshape(len(flat), -1), table.column("radius").to_numpy(), table.column("reach").to_numpy()
    own = tuple(c[first] for c in columns)
    return own, own if first.all() else tuple(c[~first] for c in columns), bool(first.all())


def _paired(heads: DataFrame, pairs: DataFrame, of, schema: str) -> DataFrame:
    both = heads.join(F.broadcast(pairs), F.col("block") == F.col("p")).unionByName(heads.join(F.broadcast(pairs.filter("p < q")), F.col("block") == F.col("q")))  # a few pairs a block
    return both.select("p", "q", "block", "comp", "x", "radius", "reach").repartition(max(1, min(trees.MOST_TASKS, pairs.count())), "p", "q").groupBy("p", "q").applyInArrow(of, schema)


def _parts(method: str):
    def run(batches):
        for batch in batches:
            sides = []
            for name in ("here", "there"):
                rows = batch.column(name)
                each = rows.flatten()
                x = each.field("x")
                sides.append((np.r_[0, np.cumsum(rows.value_lengths().to_numpy())], np.asarray(x.flatten(), float).reshape(len(x), -1), each.field("weight").to_numpy(zero_copy_only=False)))
            out = np.empty(batch.num_rows)
            (s, x, w), (t, y, v) = sides
            for k in range(len(out)):
                i, j = slice(s[k], s[k + 1]), slice(t[k], t[k + 1])
                d = repeats.between(x[i], y[j])
                out[k] = d.max() if method == "complete" else w[i] @ d @ v[j]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "d"])

    return run


def _near(own: DataFrame) -> DataFrame:
    """(a, b), a < b: the clusters (comp, x, radius) that may be nearest to each other; a task has two slabs of centres, or all of a few."""
    if own.count() <= CENTRES:
        return own.select(F.lit(0).alias("block"), "comp", "x", "radius", F.lit(0.0).alias("reach")).groupBy(F.lit(0).alias("_all")).applyInArrow(_few_candidates, "a long, b long")  # at most CENTRES
    at, blocks = trees.blocked(own.select(F.col("comp").alias("id"), "x"))
    heads = stored(at.select(F.col("id").alias("comp"), "c", "block").join(own, "comp").withColumn("reach", F.lit(0.0)))
    near = heads.sparkSession.range(blocks).select(F.col("id").cast("int").alias("p")).select("p", F.explode(F.sequence("p", F.least(F.col("p") + 1, F.lit(blocks - 1)))).alias("q"))
    reach = _paired(heads, near, _bounds, "comp long, reach double").groupBy("comp").agg(F.min("reach").alias("reach"))
    told = stored(heads.drop("reach").join(reach, "comp"))
    slabs = stored(told.groupBy("block").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("reach").alias("top")))
    p, q = slabs.alias("p"), slabs.alias("q")
    close = (F.col("q.low") - F.col("p.high")) <= F.greatest("p.top", "q.top") * (1 + 1e-9)
    pairs = stored(p.join(F.broadcast(q), (F.col("p.block") <= F.col("q.block")) & close).select(F.col("p.block").alias("p"), F.col("q.block").alias("q")))
    free(at, heads)
    return _paired(told, pairs, _candidates, "a long, b long")


def _apart(state: DataFrame, method: str) -> DataFrame | None:
    """(comp, height, u, v): the distances of each cluster to those that may be its nearest; None if these are so many that all pairs of blocks move fewer points."""
    dims = state.agg(F.max(F.size("x")).alias("p")).first()["p"]
    centres = state.groupBy("comp").agg(F.array(*[F.sum(F.col("weight") * F.col("x")[k]) / F.sum("weight") for k in range(dims)]).alias("centre"), F.count(F.lit(1)).alias("n"))
    far = F.sqrt(F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
    radius = F.max(far) if method == "complete" else F.sum(F.col("weight") * far)
    own = stored(state.join(centres, "comp").groupBy("comp").agg(F.first("centre").alias("x"), F.first("n").alias("n"), radius.alias("radius")))
    met = stored(_near(own))
    sizes = own.select("comp", "n")
    moved = met.join(sizes.select(F.col("comp").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("comp").alias("b"), F.col("n").alias("nb")), "b")
    parts = lambda c: F.ceil(F.col(c) / PART)
    cost = moved.agg(F.sum(F.col("na") * parts("nb") + F.col("nb") * parts("na")).alias("cost")).first()["cost"]
    points = state.count()
    found = None
    if cost <= points * max(8, -(-points // BLOCK)):
        packed = state.join(sizes, "comp").groupBy("comp", F.pmod(F.xxhash64("x"), parts("n")).alias("part")).agg(F.sort_array(F.collect_list(F.struct("x", "weight"))).alias("points"))  # some PART
        packed = stored(packed)
        deals = 4 * max(1, state.sparkSession.sparkContext.defaultParallelism)
        here, there = packed.select(F.col("comp").alias("a"), F.col("points").alias("here")), packed.select(F.col("comp").alias("b"), F.col("points").alias("there"))
        each = met.repartition(deals, "a").join(here, "a").join(there.hint("shuffle_hash"), "b").select("a", "b", "here", "there").mapInArrow(_parts(method), "a long, b long, d double")
        whole = F.max("d") if method == "complete" else F.aggregate(F.sort_array(F.collect_list("d")), F.lit(0.0), lambda a, v: a + v)  # in one order, so that ties stay ties
        exact = stored(each.groupBy("a", "b").agg(whole.alias("height")))
        free(packed)
        found = exact.select(F.col("a").alias("comp"), "height", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(exact.select(F.col("b").alias("comp"), "height", F.col("a").alias("u"), F.col("b").alias("v")))
    free(own, met)
    return found


def _met(state: DataFrame, of, schema: str) -> DataFrame:
    blocks = max(1, -(-state.count() // BLOCK))
    own = state.withColumn("block", F.pmod(F.xxhash64("comp"), F.lit(blocks)).cast("int"))
    return trees.block_pairs(own, blocks, ["comp", "x", "weight"]).groupBy("p", "q").applyInArrow(of, schema)


def _merged(state: DataFrame, pairs: DataFrame, method: str) -> DataFrame:
    """The state after the clusters of each pair became one, named by its smallest id, with the weights that the method's distances need."""
    told = pairs.select(F.col("u").alias("comp"), F.col("u").alias("into")).unionByName(pairs.select(F.col("v").alias("comp"), F.col("u").alias("into")))
    both = state.join(told, "comp", "left")
    name = F.coalesce("into", "comp").alias("comp")
    if method == "ward":
        # A row or two of a cluster: the centre by sizes.
        sums = both.groupBy(name).agg(F.sum("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("comp", "x", "weight"))).alias("parts"))
        p, q = F.col("parts")[0], F.get("parts", F.lit(1))
        centre = F.when(F.size("parts") == 1, p["x"]).otherwise(F.zip_with(p["x"], q["x"], lambda a, b: (a * p["weight"] + b * q["weight"]) / F.col("weight")))
        return sums.select("comp", centre.alias("x"), "weight")
    moved = both.select(name, "x", F.when(F.col("into").isNotNull(), F.col("weight") / 2).otherwise(F.col("weight")).alias("weight"))
    if method != "average":
        return moved
    sizes = moved.groupBy("comp").agg((1.0 / F.count(F.lit(1))).alias("share"))
    return moved.join(sizes, "comp").select("comp", "x", F.col("share").alias("weight"))


def linked(points: DataFrame, method: str, k: int | None = None, height: float | None = None) -> DataFrame:
    """(id, cluster): a linkage of points cut into k clusters, or at a height; a cluster is named by its smallest id."""
    tree = merge_tree(points, method)
    if "step" in tree.columns:
        tree = tree.select("u", "v", F.col("step" if k is not None else "reach").alias("height"))
    return trees.cut_tree(points, tree, k, height)
