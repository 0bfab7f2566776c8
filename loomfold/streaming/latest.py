"""Streaming forms of two batch operators: the earliest date per subject, and the newest version of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def earliest_dates(stream: DataFrame, key: str, date: str) -> DataFrame:
    """A running minimum per key; write it in update or complete mode."""
    return stream.groupBy(key).agg(F.min(date).alias("ref_date"))


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per window and key; written in append or update mode (run_once), events later than the watermark are left out and their windows' state is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).count().select(F.col("w.start").alias("start"), key, "count")


def upsert_newest(path: str, keys: list[str], version: str):
    """A foreachBatch function that keeps the highest version of each key in a Parquet table.

    The table is written anew beside the old one and named by the batch, so a batch that is run again gives the same table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        old = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []
        old = [b for b in old if b < batch_id]
        rows = batch.unionByName(spark.read.parquet(f"{path}/batch={old[-1]}")) if old else batch
        top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
        top.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_once(result: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Takes all that a stream has now through an aggregation, in update mode, and gives its whole result: the last row told for each key.

    A batch writes its changed keys under its number, so one that runs again writes the same; a later call goes on from the checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    query = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    told = result.sparkSession.read.option("basePath", f"{path}/table").parquet(f"{path}/table")
    return told.groupBy(*keys).agg(F.max_by(F.struct(*result.columns), "batch").alias("r")).select("r.*")
