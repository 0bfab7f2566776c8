"""Queries over clustering that holds no matrix and no group of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixtures, stability, trees, unimodal
from ..sources.tables import table
from .resampling import LABELS_SQL, PAIRS_SQL, labels


def chains(s, d):
    """The suppliers along two parallel lines, odd and even keys: what is near along a line is far across, and each line is long."""
    c = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") * 1e-6).alias("a"))
    return c.select("id", F.array(F.col("id") * 0.1 + F.col("a"), (F.col("id") % 2) * 5.0).alias("x"))


CHAIN_SQL = "p as (select s_suppkey as id, s_suppkey * 0.1::double + s_acctbal * 1e-6::double as x, (s_suppkey % 2) * 5.0::double as y from supplier)"


def clouds(s, d):
    """The customers in three clouds of unequal spread, by key: of deviation 1, 0.5 and 2."""
    h = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", "c_custkey", F.lit(k))), 1, 8), 16, 10).cast("double") / 2**32
    z = lambda k: F.sqrt(-2 * F.log(1 - h(k) * 0.999999)) * F.cos(6.283185307179586 * h(k + 1))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), z(1).alias("a"), z(3).alias("b"), (F.col("c_custkey") % 3).alias("g"))
    at = lambda *v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), (F.col("g") + 1).cast("int"))
    return c.select("id", "g", F.array(at(0, 12, 0) + F.col("a") * at(1, 0.5, 2), at(0, 0, 20) + F.col("b") * at(1, 0.5, 2)).alias("x"))


def named(found, by="cluster"):
    """Labels named by their smallest id."""
    first = found.groupBy(by).agg(F.min("id").alias("first"))
    return found.join(first, by).select("id", F.col("first").alias("cluster"))


def centres(s, d):
    """Each cloud's centre by k-means: the mean of its customers."""
    found, _ = mixtures.kmeans(clouds(s, d), 3)
    both = found.join(clouds(s, d), "id")
    return both.groupBy("cluster").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x")[0]), 6).alias("x"), F.round(F.avg(F.col("x")[1]), 6).alias("y"), F.round(F.sum("distance"), 4).alias("inertia")).drop("cluster")


def likelihood(s, d):
    """Rounds of the mixture: that the likelihood never falls, and the number of clouds found."""
    fitted = mixtures.gaussian_mixture(clouds(s, d), 3)
    found = mixtures.assign(clouds(s, d), fitted)
    grows = all(b >= a - 1e-7 * abs(a) for a, b in zip(fitted.history, fitted.history[1:], strict=False))
    return found.groupBy("cluster").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).select("first", "n", F.lit(grows).alias("grows"))


def dips(s, d):
    """Of the suppliers' distances along one line and between two: the dip, and whether it is told to have one mode."""
    return unimodal.distance_dip(chains(s, d)).select("n", F.round("dip", 8).alias("dip"))


QUERIES = {
    "single_linkage_tree": lambda s, d: trees.spanning_tree(chains(s, d)).select("u", "v", F.round("height", 8).alias("height")),
    "single_linkage_cut": lambda s, d: trees.single_linkage(chains(s, d), k=2),
    "consensus_tree": lambda s, d: trees.tree_heights(trees.consensus_tree_of(*stability.consensus_kinds(labels(s, d), [])).withColumn("height", F.round("height", 8))),
    "kmeans_rows": lambda s, d: named(mixtures.kmeans(clouds(s, d), 3)[0]),
    "kmeans_centres": centres,
    "mixture_rows": likelihood,
    "distance_dip": dips,
}

#: Largest step on the best path of each pair: squared often enough for 2,048 suppliers (a distance below it is an edge of the tree).
_STEPS = ", ".join(f"w{k + 1} as materialized (select a.i, b.j, min(greatest(a.d, b.d)) as d from w{k} a join w{k} b on a.j = b.i group by a.i, b.j)" for k in range(7))
_TREE = f"{CHAIN_SQL}, w0 as materialized (select a.id as i, b.id as j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from p a, p b), {_STEPS}"
ORACLES = {
    "single_linkage_tree": f"with {_TREE} select w0.i as u, w0.j as v, round(w0.d, 8) as height from w0 join w7 using (i, j) where w0.i < w0.j and w0.d <= w7.d",
    "single_linkage_cut": "select s_suppkey as id, min(s_suppkey) over (partition by s_suppkey % 2) as cluster from supplier",
    "consensus_tree": f"""with {LABELS_SQL}, {PAIRS_SQL}, w0 as materialized (select i, j, 1 - m as d from co union all select j, i, 1 - m from co union all select distinct i, i, 0.0::double from (select i from co union all select j from co)), {_STEPS},
      g as (select distinct round(d, 8) as h from w7 where i <> j), c as (select h, (select count(distinct f) from (select w.i, min(w.j) as f from w7 w where round(w.d, 8) <= h group by w.i)) as parts from g), n as (select count(distinct i) as parts from w0)
      select h as height, coalesce(lag(parts) over (order by h), (select parts from n)) - parts as merges from c""",
    "kmeans_rows": "select c_custkey as id, min(c_custkey) over (partition by c_custkey % 3) as cluster from customer",
    "mixture_rows": "select min(c_custkey) as first, count(*) as n, true as grows from customer group by c_custkey % 3",
}
