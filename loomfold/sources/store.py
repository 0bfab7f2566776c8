"""Tables that cut a long plan: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local session that names none gets a folder of its own; a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="loomfold-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def stored(df: DataFrame) -> DataFrame:
    """df, written and read again; deleted by free(), or when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomfold_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        _forget(df.sparkSession, df._loomfold_path)
