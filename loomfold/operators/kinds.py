"""Pairs of ids by their kinds: ids with the same labels in the same sets are one kind, and what holds for a pair of kinds holds for all pairs of their members.

Label sets are long: (keys, id, by, label), by naming the set. Kinds are compared with each other, never ids; who wants pairs of ids gets them as a join
of members, in blocks, without an aggregation over pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

#: Kinds of a block of their grid.
KINDS = 512


def members(labels: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, id, kind, seen), a row per id: seen are its labels in every set, kind is the smallest id that has the same; stored."""
    own = labels.filter(F.col("id").isNotNull() & F.col(by).isNotNull())
    seen = stored(own.groupBy(*keys, "id").agg(F.sort_array(F.collect_list(F.struct(F.col(by).alias("by"), "label"))).alias("seen")))  # one entry per set
    first = seen.groupBy(*keys, "seen").agg(F.min("id").alias("kind"))
    return stored(seen.join(first, [*keys, "seen"]).select(*keys, "id", "kind", "seen"))


def kind_pairs(own: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, agree, told, common) of every ordered pair of kinds with a set in common, a kind with itself too; stored.

    common counts the sets (each entry with each, where a set tells an id twice), told those where both have a label, agree those of equal labels.
    """
    kinds = stored(own.filter("id = kind").select(*keys, "kind", "seen"))
    blocks = max(1, -(-kinds.count() // KINDS))
    block = lambda name: F.pmod(F.xxhash64("kind"), F.lit(blocks)).alias(name)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = kinds.select(*keys, F.col("kind").alias("a"), F.col("seen").alias("x"), block("row"), every.alias("column"))
    right = kinds.select(*keys, F.col("kind").alias("b"), F.col("seen").alias("y"), block("column"), every.alias("row"))
    both = left.hint("shuffle_hash").join(right.hint("shuffle_hash"), [*keys, "row", "column"])
    count = lambda holds: F.aggregate("x", F.lit(0).cast("long"), lambda n, e: n + F.size(F.filter("y", lambda f: (e["by"] == f["by"]) & holds(e, f))))
    counted = both.select(
        *keys, "a", "b", count(lambda e, f: e["label"] == f["label"]).alias("agree"), count(lambda e, f: e["label"].isNotNull() & f["label"].isNotNull()).alias("told"), count(lambda e, f: F.lit(True)).alias("common")
    )
    return stored(counted.filter("common > 0"))


def expanded(own: DataFrame, pairs: DataFrame, keys: list[str], *columns: str, block: int = 4096) -> DataFrame:
    """(keys, i, j, columns) of the members i < j of every pair of kinds (keys, a, b, columns): as quadratic as its result, in tasks of bounded joins that nothing follows."""
    sizes = own.groupBy(*keys, F.col("kind").alias("b")).agg((F.floor((F.count(F.lit(1)) - 1) / block) + 1).alias("blocks"))
    right = own.select(*keys, F.col("kind").alias("b"), F.col("id").alias("j")).join(sizes, [*keys, "b"]).select(*keys, "b", "j", F.pmod(F.xxhash64("j"), F.col("blocks")).alias("block"))
    met = pairs.join(sizes, [*keys, "b"]).select(*keys, "a", "b", *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    left = own.select(*keys, F.col("kind").alias("a"), F.col("id").alias("i")).join(met, [*keys, "a"]).select(*keys, "i", "b", "block", *columns)
    # By what the members join on, not broadcast, and in a number of tasks that small tables do not lower: else the few tasks that read them make all pairs.
    # Dealt by i as well, so that few kinds are many tasks.
    deals = 4 * max(1, own.sparkSession.sparkContext.defaultParallelism)
    left = left.withColumn("deal", F.pmod(F.xxhash64("i"), F.lit(deals)))
    right = right.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    at = [*keys, "deal", "b", "block"]
    return left.repartition(deals, *at).join(right.repartition(deals, *at).hint("shuffle_hash"), at).filter("i < j").select(*keys, "i", "j", *columns)
