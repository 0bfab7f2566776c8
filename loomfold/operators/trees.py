"""Single linkage of any number of rows: a minimum spanning tree by rounds, cut by number or height.

The merge heights of single linkage are the edges of the minimum spanning tree, so no matrix of distances is kept. A round
(Boruvka's) finds the least edge that leaves each component: equal points are one, the others are cut into slabs whose number grows with theirs, a pair of slabs is a
task (only pairs near enough for an edge below the least that each component has with its own and the next slab), and a task emits an edge for each component it holds, the least of which an aggregate takes. The edges found join the components, of which at
most half are left: 10^6 rows take twenty rounds at most, and what goes from round to round is a component for each row.

Edges are in order of height and then of their two ids, so equal heights make one tree however the rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import repeats
from ..sources.store import free, stored

#: Rows of a block; a task holds two blocks and their distances a strip at a time.
BLOCK, STRIP = 2048, 256
#: Tasks of a round at most.
MOST_TASKS = 2000
#: Links between components up to which the driver joins them, and one task; more are first made fewer by rounds of joins.
FEW, MANY = 50_000, 4_000_000


def blocked(points: DataFrame) -> tuple[DataFrame, int]:
    """points (id, x) with block, c and the number of blocks: slabs along the coordinate c that varies most, in its order; ids must not repeat."""
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).first()
    blocks = max(1, -(-size["n"] // BLOCK))
    spread = points.agg(*[F.var_pop(F.col("x")[k]).alias(f"v{k}") for k in range(size["p"] or 0)]).first() if blocks > 1 else ()
    widest = max(range(len(spread)), key=lambda k: spread[k] or 0.0) if len(spread) else 0
    own = points.select("id", "x", F.get("x", F.lit(widest)).alias("c"))
    if blocks > 1:
        own = own.repartitionByRange(blocks, "c", "id")
    return stored(own.select("id", "x", "c", (F.spark_partition_id() if blocks > 1 else F.lit(0)).alias("block"))), blocks


def block_pairs(own: DataFrame, blocks: int, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Each row of own (block, columns) once for each pair of blocks (p, q), p <= q, that has its block; a task has few pairs. by: columns within which pairs are formed."""
    by = by or []
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    both = own.select("block", *columns, other)
    both = both.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", *columns)
    return both.repartition(min(MOST_TASKS, blocks * (blocks + 1) // 2), *by, "p", "q")  # a number that small tables do not lower


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1)


def _least_edges(table: pa.Table) -> pa.Table:
    """Of two blocks: for each component the least edge between the blocks (or within the one) that leaves it."""
    table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
    block = table.column("block").to_numpy()
    first = block == block.min()
    ids, comp, x = table.column("id").to_numpy(), table.column("comp").to_numpy(), _vectors(table.column("x"))
    rows, cols = np.flatnonzero(first), np.flatnonzero(~first if not first.all() else first)
    # Rows are in order of ids, so the first of the nearest makes the edge of smallest ids.
    near, to = np.full(len(rows), np.inf), np.zeros(len(rows), int)
    back, of = np.full(len(cols), np.inf), np.zeros(len(cols), int)
    for k in range(0, len(rows), STRIP):
        at = slice(k, k + STRIP)
        d = repeats.between(x[rows[at]], x[cols])
        d[comp[rows[at], None] == comp[None, cols]] = np.inf
        to[at] = d.argmin(axis=1)
        near[at] = d[np.arange(len(d)), to[at]]
        if not first.all():
            up = d.argmin(axis=0)
            least = d[up, np.arange(len(cols))]
            closer = least < back
            back[closer], of[closer] = least[closer], up[closer] + k
    mine, theirs, height = np.r_[rows, cols], np.r_[cols[to], rows[of]], np.r_[near, back]
    some = np.isfinite(height)
    mine, theirs, height = mine[some], theirs[some], height[some]
    u, v = np.minimum(ids[mine], ids[theirs]), np.maximum(ids[mine], ids[theirs])
    order = np.lexsort((v, u, height, comp[mine]))
    names = comp[mine][order]
    order = order[np.flatnonzero(np.r_[True, names[1:] != names[:-1]])] if len(order) else order
    return pa.table({"comp": comp[mine][order], "height": height[order], "u": u[order], "v": v[order]})


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """comps (id, comp) after the components that edges (u, v) join became one, named by its smallest."""
    ends = edges.join(comps.select(F.col("id").alias("u"), F.col("comp").alias("a")), "u").join(comps.select(F.col("id").alias("v"), F.col("comp").alias("b")), "v").select("a", "b")
    ends = stored(ends)
    pairs = ends.limit(FEW + 1).collect()
    if len(pairs) <= FEW:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        told = comps.sparkSession.createDataFrame([(c, find(c)) for c in list(root)], "comp long, root long")
        out = stored(comps.join(F.broadcast(told), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))  # at most twice FEW rows
        free(ends)
        return out
    while ends.count() > MANY:
        # Each component hooks to its least neighbour, if that is less than itself: of a chain of random names a third is left.
        links = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = held = stored(links.groupBy("a").agg(F.least("a", F.min("b")).alias("root")))
        while True:
            new = stored(roots.join(roots.select(F.col("a").alias("root"), F.col("root").alias("up")), "root").select("a", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            done = new.filter("moved").isEmpty()
            free(held)
            roots, held = new.select("a", "root"), new
            if done:
                break
        comps = stored(_renamed(comps, roots))
        at = roots.withColumnRenamed("root", "x"), roots.select(F.col("a").alias("b"), F.col("root").alias("y"))
        fewer = stored(ends.join(at[0], "a").join(at[1], "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        free(ends, held)
        ends = fewer
    out = stored(_renamed(comps, ends.groupBy(F.lit(0).alias("_all")).applyInArrow(_joined, "a long, root long")))  # at most MANY links
    free(ends)
    return out


def _renamed(comps: DataFrame, roots: DataFrame) -> DataFrame:
    return comps.join(roots.select(F.col("a").alias("comp"), "root"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))


def _joined(links: pa.Table) -> pa.Table:
    """(a, root): the components of links (a, b), named by their smallest."""
    ends = np.r_[links.column("a").to_numpy(), links.column("b").to_numpy()]
    names, at = np.unique(ends, return_inverse=True)
    u, v = at[: len(links)], at[len(links) :]
    root = np.arange(len(names))
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return pa.table({"a": names, "root": names[root]})


def spanning_tree(points: DataFrame) -> DataFrame:
    """(u, v, height), u < v: the minimum spanning tree of points (id, x) under Euclidean distance; n - 1 rows, stored.

    Ids are whole numbers and must not repeat; a null id or vector is left out, vectors have one length. One point, or none, has no edge.
    """
    every = points.filter("id is not null and x is not null").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    points, tree = collapsed(every)
    own, blocks = blocked(points.select("id", "x"))
    comps = stored(own.select("id", F.col("id").alias("comp")))
    n = own.count()
    found = 0
    while found < n - 1:
        at = stored(own.join(comps, "id"))
        least = _least(at, blocks)
        edges = stored(least.select("e.u", "e.v", "e.height").distinct())  # two components may choose one edge
        after = merged(comps, edges)
        free(comps, at)
        comps, tree = after, tree.unionByName(edges)
        found += edges.count()
    out = stored(tree)
    free(own, comps)
    return out


def collapsed(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, x, n): of n equal points the one of smallest id, stored; and the edges (u, v, height 0) of the others to it."""
    first = stored(points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    same = points.select("x", F.col("id").alias("v")).join(first.filter("n > 1").select("x", F.col("id").alias("u")), "x")
    return first, stored(same.filter("u <> v").select("u", "v", F.lit(0.0).alias("height")))


def _met(at: DataFrame, pairs: DataFrame, tasks: int) -> DataFrame:
    """The least edges of each component between the two blocks of each pair (p, q)."""
    both = at.join(F.broadcast(pairs), F.col("block") == F.col("p")).unionByName(at.join(F.broadcast(pairs.filter("p < q")), F.col("block") == F.col("q")))  # a few pairs a block
    each = both.select("p", "q", "id", "x", "comp", "block").repartition(max(1, min(MOST_TASKS, tasks)), "p", "q").groupBy("p", "q").applyInArrow(_least_edges, "comp long, height double, u long, v long")
    return each.groupBy("comp").agg(F.min(F.struct("height", "u", "v")).alias("e"))


def _least(at: DataFrame, blocks: int) -> DataFrame:
    """(comp, e) of the least edge that leaves each component: first within slabs and to the next, which bounds it, then between those further apart that may have a lesser one."""
    near = at.sparkSession.range(blocks).select(F.col("id").cast("int").alias("p")).select("p", F.explode(F.sequence("p", F.least(F.col("p") + 1, F.lit(blocks - 1)))).alias("q"))
    first = _met(at, near, 2 * blocks)
    if blocks < 3:
        return first
    first = stored(first)
    bound = F.coalesce(F.col("e.height"), F.lit(float("inf")))
    slabs = stored(at.join(first, "comp", "left").groupBy("block").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.max(bound).alias("top")))
    p, q = slabs.alias("p"), slabs.alias("q")
    apart = (F.col("q.low") - F.col("p.high")) <= F.greatest("p.top", "q.top") * (1 + 1e-12)
    one = (F.col("p.a") == F.col("p.b")) & (F.col("q.a") == F.col("q.b")) & (F.col("p.a") == F.col("q.a"))
    pairs = stored(p.join(F.broadcast(q), (F.col("p.block") + 1 < F.col("q.block")) & apart & ~one).select(F.col("p.block").alias("p"), F.col("q.block").alias("q")))
    n = pairs.count()
    if not n:
        return first
    return first.unionByName(_met(at, pairs, n)).groupBy("comp").agg(F.min("e").alias("e"))


def cut_tree(points: DataFrame, tree: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    """(id, cluster): single linkage of points cut into k clusters, or at a height (edges up to it hold); a cluster is named by its smallest id."""
    if k is not None:
        last = tree.orderBy(F.desc("height"), F.desc("u"), F.desc("v")).limit(max(0, k - 1))  # k - 1 rows
        kept = tree.join(F.broadcast(last.select("u", "v")), ["u", "v"], "left_anti")
    else:
        kept = tree.filter(F.col("height") <= height)
    own = points.filter("id is not null and x is not null").select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("comp"))
    return merged(stored(own), stored(kept.select("u", "v"))).withColumnRenamed("comp", "cluster")


def single_linkage(points: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    return cut_tree(points, spanning_tree(points), k, height)


def consensus_tree(consensus: DataFrame, ids: DataFrame) -> DataFrame:
    """(u, v, height): the minimum spanning tree of 1 - m over the pairs (i, j, m) of a consensus, pairs not in it being 1 apart; by the same rounds, over edges."""
    edges = stored(consensus.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), (1.0 - F.col("m")).alias("height")))
    comps, tree = stored(ids.select("id", F.col("id").alias("comp")).distinct()), None
    while True:
        at = comps.select(F.col("id").alias("u"), F.col("comp").alias("a")), comps.select(F.col("id").alias("v"), F.col("comp").alias("b"))
        apart = edges.join(at[0], "u").join(at[1], "v").filter("a <> b")
        ends = apart.select(F.col("a").alias("comp"), "height", "u", "v").unionByName(apart.select(F.col("b").alias("comp"), "height", "u", "v"))
        least = stored(ends.groupBy("comp").agg(F.min(F.struct("height", "u", "v")).alias("e")).select("e.u", "e.v", "e.height").distinct())
        if least.isEmpty():
            break
        after = merged(comps, least)
        free(comps)
        comps, tree = after, least if tree is None else tree.unionByName(least)
    # What no pair joins is 1 apart: each further component's first id to the first of all.
    heads = stored(comps.groupBy("comp").agg(F.min("id").alias("head")))
    first = heads.agg(F.min("head").alias("u"))
    rest = heads.crossJoin(F.broadcast(first)).filter("head > u").select("u", F.col("head").alias("v"), F.lit(1.0).alias("height"))  # one row
    return stored(rest if tree is None else tree.unionByName(rest))


def consensus_tree_of(own: DataFrame, told: DataFrame) -> DataFrame:
    """consensus_tree of the consensus of kinds (stability.consensus_kinds), without pairs of ids: that of the kinds' first ids, to which the others of a kind are joined."""
    same = told.filter("a = b").select(F.col("a").alias("kind"), F.coalesce(1.0 - F.col("m"), F.lit(1.0)).alias("height"))
    star = own.filter("id <> kind").join(same, "kind").select(F.col("kind").alias("u"), F.col("id").alias("v"), "height")
    between = consensus_tree(told.filter("a < b and m is not null").select(F.col("a").alias("i"), F.col("b").alias("j"), "m"), own.filter("id = kind").select("id"))
    return stored(star.unionByName(between))


def tree_heights(tree: DataFrame) -> DataFrame:
    """(height, merges): how many merges of the linkage have each height."""
    return tree.groupBy("height").agg(F.count(F.lit(1)).alias("merges"))

