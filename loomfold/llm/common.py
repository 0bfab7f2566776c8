"""What the corpus operators share: the whitespace class, shared-folder tables and plain readers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII whitespace characters that the contracts name.
SPACE = r"[\x20\x09-\x0D]"
#: A maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
BATCH = 250
#: Bits of a bitmap at most, as a power of two: 16 MB.
MAP_BITS = 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def row_key(docs: DataFrame, *more: str) -> Column:
    """key, the hash of a row's doc_id and text (and more); null where each is null counts as a value."""
    return F.xxhash64(*[x for c in ("doc_id", *more, "text") for x in (F.col(c).isNull(), c)]).alias("key")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one of its own (tests); a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="loomfold-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def text_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches at most BATCH rows: ten thousand texts at once would fill buffers outside the heap."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return df


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def settle(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors. free() deletes it, at the latest the end does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomfold-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomfold_path = path
    return out


def free(*settled: DataFrame) -> None:
    """Deletes tables that settle() wrote, once nothing will read them again."""
    for df in settled:
        _forget(df.sparkSession, df._loomfold_path)


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """The last bits (the first ones of minimisers are all small) of a column of 64-bit hashes: at most 2**MAP_BITS bits, whatever the input; built word by word where the hashes are."""
    bits = min(MAP_BITS, max(10, (16 * hashes.count()).bit_length()))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bitmap; false ones may pass, none is lost."""
    at = h & np.uint64((len(words) << 6) - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def possible(df: DataFrame, column: str, wanted: DataFrame, of: str) -> DataFrame:
    """The rows of df whose hash may be among wanted's: before a join, so that the others' texts are not shuffled."""
    words = df.sparkSession.sparkContext.broadcast(bitmap(wanted, of))

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(words.value, h.to_numpy(np.int64).view(np.uint64)))

    return df.filter(may_be(column))
