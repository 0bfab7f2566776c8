"""Deterministic random order by hash, and ranks that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_key(seed: object, *ids: str) -> Column:
    """md5 of ``id:...:seed`` as hex; Spark and other engines give the same."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def ranked(df: DataFrame, key: Column, ties: list[str], by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """df with ``rank`` (from 1, in the order of a hex key, then ties) and ``n``, over all rows or per group of by.

    The leading hex digits split the order into 16**digits buckets: rows are ranked within a bucket, and bucket
    totals, a small table, add what comes before. A bucket holds 1/4096 of a group, so one hot group is many tasks.
    """
    by = by or []
    own = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = own.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    order = W.partitionBy(*by).orderBy("_bucket")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_count").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("n", F.sum("_count").over(W.partitionBy(*by)))
    within = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_key", *ties))
    on = F.col("l._bucket") == F.col("r._bucket")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = own.withColumn("_within", within).alias("l").join(counts.alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_before") + F.col("_within")).alias("rank"), F.col("r.n").alias("n"))
