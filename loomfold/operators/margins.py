"""Tables with given margins: sampled for Monte-Carlo tests, and enumerated by a network for the exact test.

A test is a table of counts, groups by levels. Relabelling rows changes the cells and never the margins, so a replicate is one draw of a table
from its margins: no row of the data is copied, ranked or shuffled for it, and 20,000 replicates of a table of a billion rows cost as
much as those of a table of ten. A test's counts come from one aggregate; replicates are dealt to tasks in blocks, each with a seed of its own.

The exact test of two groups walks a network: a node is what the columns so far took of the first group, with the weight of a path to it. Nodes of all tests
go from column to column as one DataFrame: each is joined with the least and the greatest weight still to come, counted or dropped whole
where these decide, and merged with others of equal weight where not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pvalues
from ..sources.store import stored
from .inference import bh

#: Replicates of a Monte-Carlo test, and of a task; cells of a table at most (beyond it a test has no p).
REPLICATES, BLOCK, MOST_CELLS = 20_000, 1000, 10_000
#: Above this total a hypergeometric draw is a rounded normal one of the same mean and variance.
EXACT_BELOW = 10**9
#: The exact test: rows of a table at most, and nodes of a test between two columns; beyond either the p is sampled.
MOST_ROWS, MOST_NODES = 2000, 200_000
#: Tables are no likelier than the one seen up to this relative difference.
SLACK = 1e-7


def tables(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per test: keys, n, in_group and in_level (margins, in order of their values), cells (row by row), chi2 and df.

    rows has the keys, group and level; where either is null the row is left out. Keys may be null. A test of one group or one level has df 0 and chi2 0; one of
    more than MOST_CELLS cells has null cells. An empty table gives none.
    """
    counts = rows.filter("group is not null and level is not null").groupBy(*keys, "group", "level").agg(F.count(F.lit(1)).alias("n"))
    at = lambda c: F.dense_rank().over(W.partitionBy(*keys).orderBy(c)) - 1  # noqa: E731  (a row a cell)
    cells = counts.withColumn("g", at("group")).withColumn("l", at("level"))
    sizes = cells.groupBy(*keys).agg((F.max("g") + 1).alias("r"), (F.max("l") + 1).alias("c"), F.sum("n").alias("n"))
    within = F.col("r").cast("long") * F.col("c") <= MOST_CELLS
    small = sizes.filter(within)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    wide = cells.alias("a").join(small.select(*keys).alias("b"), on, "left_semi") if keys else cells.join(small.select(F.lit(1)).limit(1).hint("broadcast"), F.lit(True), "left_semi")
    dense = wide.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("g", "l"), "n"))).alias("some"))  # at most MOST_CELLS entries
    if keys:
        both = sizes.alias("a").join(dense.alias("b"), on, "left").select(*[F.col(f"a.{k}") for k in keys], "r", "c", F.col("a.n").alias("n"), "some")
    else:
        both = sizes.crossJoin(dense)  # one row each
    of = lambda i, j: F.coalesce(F.try_element_at("some", F.struct(i.cast("int").alias("g"), j.cast("int").alias("l"))), F.lit(0).cast("long"))
    span = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    grid = F.transform(span("r"), lambda i: F.transform(span("c"), lambda j: of(i, j)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    out = both.withColumn("grid", F.when(F.col("some").isNotNull(), grid))
    out = out.withColumn("in_group", F.transform("grid", total)).withColumn("in_level", F.transform(span("c"), lambda j: total(F.transform("grid", lambda row: F.get(row, j)))))
    out = out.withColumn("in_level", F.when(F.col("grid").isNotNull(), F.col("in_level"))).withColumn("cells", F.flatten("grid"))
    share = F.aggregate(
        F.sequence(F.lit(0), F.size("cells") - 1), F.lit(0.0), lambda s, k: s + F.pow(F.get("cells", k).cast("double"), 2) / (F.get("in_group", F.floor(k / F.col("c")).cast("int")).cast("double") * F.get("in_level", k % F.col("c")))
    )
    return out.select(*keys, "n", "in_group", "in_level", "cells", F.greatest(F.lit(0.0), F.col("n") * (share - 1.0)).alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).cast("long").alias("df"))


def dealt(in_group: np.ndarray, in_level: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """size tables (size, groups, levels) of these margins, each as likely as random labels make it: cell by cell, given the cells before."""
    out = np.zeros((size, len(in_group), len(in_level)), np.int64)
    left = np.repeat(np.asarray(in_level, np.int64)[None], size, axis=0)
    for i, whole in enumerate(in_group[:-1]):
        need, rest = np.full(size, whole, np.int64), left.sum(axis=1)
        for j in range(len(in_level) - 1):
            rest = rest - left[:, j]
            out[:, i, j] = _hypergeometric(left[:, j], rest, need, rng)
            need = need - out[:, i, j]
        out[:, i, -1] = need
        left = left - out[:, i]
    out[:, -1] = left
    return out


def _hypergeometric(good: np.ndarray, bad: np.ndarray, need: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    if len(good) == 0 or max(good.max(), bad.max()) < EXACT_BELOW:
        return rng.hypergeometric(good, bad, need)
    n = np.maximum(1, good + bad).astype(float)
    spread = need * (good / n) * (bad / n) * (n - need) / np.maximum(1, n - 1)
    drawn = np.rint(need * (good / n) + np.sqrt(np.maximum(0, spread)) * rng.standard_normal(len(good))).astype(np.int64)
    return np.clip(drawn, np.maximum(0, need - bad), np.minimum(good, need))


def sampled(tests: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(keys, replicate, sampled, seen, cells): the chi-square of each replicate beside that of the table, and its cells.

    Of tests as tables() gives them; those of df 0 or null cells have no replicates. The draws follow from the seed, the keys and the replicate's block alone.
    """
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]) if keys else F.lit("")
    blocks = -(-replicates // BLOCK)
    work = tests.filter("df > 0 and cells is not null").withColumn("_name", name).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fields = [f for f in tests.schema if f.name in keys]
    schema = T.StructType([*fields, T.StructField("replicate", T.LongType()), T.StructField("sampled", T.DoubleType()), T.StructField("seen", T.DoubleType()), T.StructField("cells", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                r = dict(zip(batch.columns, row, strict=True))
                size = min(BLOCK, replicates - BLOCK * r["_block"])
                g, c = np.asarray(r["in_group"], np.int64), np.asarray(r["in_level"], np.int64)
                drawn = dealt(g, c, size, np.random.default_rng([seed, zlib.crc32(r["_name"].encode()), int(r["_block"])]))
                share = (drawn.astype(float) ** 2 / (g[:, None].astype(float) * c)).sum(axis=(1, 2))
                out = pd.DataFrame({k: [r[k]] * size for k in keys} | {"replicate": BLOCK * r["_block"] + np.arange(size), "sampled": np.maximum(0.0, r["n"] * (share - 1)), "seen": r["chi2"]})
                yield out.assign(cells=list(drawn.reshape(size, -1)))

    renamed = work.select(*keys, "n", "in_group", "in_level", "chi2", F.col("_name"), F.col("_block"))
    tasks = max(1, tests.sparkSession.sparkContext.defaultParallelism)
    return renamed.repartition(4 * tasks).mapInPandas(run, schema)


def monte_carlo(rows: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(keys, n, chi2, df, replicates, p): the share of replicates whose chi-square is no less, the table itself counted among them.

    Where there is nothing to test (see tables) replicates is 0 and p null.
    """
    tests = stored(tables(rows, keys))
    no_less = F.col("sampled") >= F.col("seen") * (1 - 64 * 2.0**-52)
    found = sampled(tests, keys, replicates, seed).groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates"), ((F.sum(no_less.cast("int")) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p"))
    return _beside(tests.select(*keys, "n", "chi2", "df"), found, keys).select(*keys, "n", "chi2", "df", F.coalesce("replicates", F.lit(0)).cast("long").alias("replicates"), "p")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return left.join(right.withColumnsRenamed({k: f"{k}_" for k in keys}), on, "left").drop(*[f"{k}_" for k in keys])


def stratified(rows: DataFrame, stratum: str, families: list[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(families, stratum, n, chi2, df, p, q): monte_carlo within each stratum of each family, and Benjamini-Hochberg within the family."""
    found = monte_carlo(rows, [*families, stratum], replicates, seed).drop("replicates")
    return bh(found, "p", families, ties=[stratum])


def agreement_p(pairs: DataFrame, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(observed, p, replicates): mean adjusted Rand index of pairs of label sets against tables of the same margins.

    pairs (b1, b2, a, b) has a row for each id that two sets share (stability.boot_pairs). Labels permuted at random give a table of the margins of the
    shared ids; tables of different pairs are pairwise independent, so a replicate is a table for each pair, and its mean index.
    A pair that agrees by necessity (one cluster in either set) has index 0, as in stability.ari.
    """
    keys = ["b1", "b2"]
    tests = stored(tables(pairs.withColumnsRenamed({"a": "group", "b": "level"}), keys).filter("n > 1 and cells is not null"))
    two = lambda x: x * (x - 1) / 2.0
    summed = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + two(x.cast("double")))
    parts = tests.select(*keys, summed("in_group").alias("sg"), summed("in_level").alias("sl"), two(F.col("n").cast("double")).alias("pairs"), summed("cells").alias("same"))
    expected, most = F.col("sg") * F.col("sl") / F.col("pairs"), (F.col("sg") + F.col("sl")) / 2
    index = lambda same: F.coalesce(F.try_divide(same - expected, most - expected), F.lit(0.0))
    seen = parts.agg(F.avg(index(F.col("same"))).alias("observed"))
    drawn = sampled(tests, keys, replicates, seed).select(*keys, "replicate", summed("cells").alias("drawn"))
    fixed = tests.filter("df = 0").agg(F.count(F.lit(1)).alias("fixed"))  # pairs without a choice add index 0
    null = _beside(drawn, parts, keys).groupBy("replicate").agg(F.sum(index(F.col("drawn"))).alias("s"), F.count(F.lit(1)).alias("k"))
    both = null.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(fixed)).withColumn("index", F.col("s") / (F.col("k") + F.col("fixed")))  # one row each
    return both.groupBy("observed").agg(((F.sum((F.col("index") >= F.col("observed") - 1e-12).cast("int")) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p"), F.count(F.lit(1)).alias("replicates"))


@F.pandas_udf(T.DoubleType())
def log_choose(n: pd.Series, k: pd.Series) -> pd.Series:
    most = int(n.max()) if len(n) else 0
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    n, k = n.to_numpy(np.int64), k.to_numpy(np.int64)
    return pd.Series(logs[n] - logs[k] - logs[n - k])


def _network(tests: DataFrame, key: str) -> DataFrame:
    """(key, p) of tests (key, n, take, level_sizes, taken): two groups, of which the first takes taken of each level; p is null for more than MOST_NODES nodes."""
    each = tests.select(key, "n", "take", F.posexplode(F.reverse(F.sort_array(F.arrays_zip("level_sizes", "taken")))).alias("j", "l"))  # large levels first
    each = each.select(key, "n", "take", "j", F.col("l.level_sizes").alias("size"), F.col("l.taken").alias("x"))
    after = F.coalesce(F.sum("size").over(W.partitionBy(key).orderBy(F.desc("j")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # rows are levels
    each = stored(each.withColumn("after", after))
    seen = each.groupBy(key).agg(F.sum(log_choose("size", "x")).alias("seen"))
    last = each.agg(F.max("j")).first()[0]
    if last is None:
        return tests.select(key, F.lit(None).cast("double").alias("p"))
    levels = [each.filter(F.col("j") == j).drop("x", "j") for j in range(last + 1)]

    def steps(nodes: DataFrame, level: DataFrame) -> DataFrame:
        """Each node with what the level may take: nodes (key, s, ...) and the tests that have the level."""
        own = nodes.join(level, key)
        low = F.greatest(F.lit(0), F.col("take") - F.col("s") - F.col("after"))
        return own.filter(low <= F.least("size", F.col("take") - F.col("s"))).withColumn("x", F.explode(F.sequence(low, F.least("size", F.col("take") - F.col("s"))))).withColumn("w", log_choose("size", "x"))

    # Weights still to come: from the last level back, for every sum that the levels before can have.
    bounds = [None] * (last + 2)
    for j in range(last, -1, -1):
        level = levels[j]
        before = F.col("n") - F.col("size") - F.col("after")
        sums = level.select(key, F.explode(F.sequence(F.greatest(F.lit(0), F.col("take") - F.col("size") - F.col("after")), F.least("take", before))).alias("s"))
        walk = steps(sums, level)
        if j < last:
            ahead = bounds[j + 1].select(key, F.col("s").alias("to"), "least", "most")
            walk = walk.withColumn("to", F.col("s") + F.col("x")).join(ahead, [key, "to"], "left")
        else:
            walk = walk.withColumn("least", F.lit(None).cast("double")).withColumn("most", F.lit(None).cast("double"))
        rest = lambda c: F.col("w") + F.coalesce(c, F.lit(0.0))
        bounds[j] = stored(walk.groupBy(key, "s").agg(F.min(rest("least")).alias("least"), F.max(rest("most")).alias("most")))

    nodes = tests.select(key, F.lit(0).cast("long").alias("s"), F.lit(0.0).alias("past"), F.lit(1.0).alias("paths"))
    counted, over = None, None
    whole = tests.select(key, log_choose("n", "take").alias("whole")).join(seen, key)
    for j in range(last + 1):
        walk = steps(nodes, levels[j]).withColumn("past", F.col("past") + F.col("w")).withColumn("s", F.col("s") + F.col("x")).select(key, "s", "past", "paths", "after", "take")
        if j < last:
            walk = walk.join(bounds[j + 1], [key, "s"], "left")
        else:
            walk = walk.withColumn("least", F.lit(None).cast("double")).withColumn("most", F.lit(None).cast("double"))
        walk = walk.join(whole, key)
        zero = F.lit(0.0)
        limit = F.col("seen") + SLACK
        state = F.when(F.col("past") + F.coalesce("most", zero) <= limit, 1).when(F.col("past") + F.coalesce("least", zero) > limit, -1).otherwise(0)
        walk = stored(walk.withColumn("state", state).filter("state >= 0"))
        done = walk.filter("state = 1").select(key, (F.col("paths") * F.exp(F.col("past") + log_choose("after", F.col("take") - F.col("s")) - F.col("whole"))).alias("p"))
        counted = done if counted is None else counted.unionByName(done)
        # Paths of equal weight to one node are one.
        nodes = walk.filter("state = 0").groupBy(key, "s", F.round("past", 9).alias("_w")).agg(F.min("past").alias("past"), F.sum("paths").alias("paths")).drop("_w")
        nodes = stored(nodes)
        crowded = stored(nodes.groupBy(key).count().filter(F.col("count") > MOST_NODES).select(key))
        over = crowded if over is None else over.unionByName(crowded)
        nodes = nodes.join(crowded, key, "left_anti")
    found = counted.groupBy(key).agg(F.least(F.lit(1.0), F.sum("p")).alias("p"))
    return tests.select(key).join(found.join(over, key, "left_anti"), key, "left")


def fisher(rows: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(keys, n, groups, levels, p, method): the exact test of each table of rows (keys, group, level).

    ``hypergeometric`` for two by two, ``network`` for two groups or two levels and up to MOST_ROWS rows, ``sampled`` (monte_carlo over replicates, by
    chi-square) for all larger ones, ``none`` and a null p for one group or one level. No levels are merged.
    """
    tests = stored(tables(rows, keys).withColumn("_key", F.monotonically_increasing_id()))
    tests = tests.withColumn("groups", F.size("in_group")).withColumn("levels", F.size("in_level"))
    two = (F.col("groups") == 2) & (F.col("levels") == 2)
    cell = lambda k: F.get("cells", F.lit(k))
    plain = tests.filter(two).select("_key", pvalues.fisher_p(cell(0), cell(1), cell(2), cell(3)).alias("p"), F.lit("hypergeometric").alias("method"))
    long = ((F.col("groups") == 2) | (F.col("levels") == 2)) & ~two & (F.col("df") > 0) & (F.col("n") <= MOST_ROWS)
    side = lambda a, b: F.when(F.col("groups") == 2, a).otherwise(b)
    level_sizes = side(F.col("in_level"), F.col("in_group"))
    walked = tests.filter(long).select("_key", "n", side(F.get("in_group", F.lit(0)), F.get("in_level", F.lit(0))).alias("take"), level_sizes.alias("level_sizes"))
    taken = tests.filter(long).select(F.col("_key"), F.transform(F.sequence(F.lit(0), F.size(level_sizes) - 1), lambda k: F.get("cells", side(k, k * 2))).alias("taken"))
    exact = _network(stored(walked.join(taken, "_key")), "_key").filter("p is not null").withColumn("method", F.lit("network"))
    known = stored(plain.unionByName(exact))
    rest = tests.filter("df > 0").join(known.select("_key"), "_key", "left_anti")
    no_less = F.col("sampled") >= F.col("seen") * (1 - 64 * 2.0**-52)
    drawn = sampled(rest, ["_key"], replicates, seed).groupBy("_key").agg(((F.sum(no_less.cast("int")) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p")).withColumn("method", F.lit("sampled"))
    return tests.join(known.unionByName(drawn), "_key", "left").select(*keys, "n", "groups", "levels", "p", F.coalesce("method", F.lit("none")).alias("method"))
