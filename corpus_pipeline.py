"""From raw documents to training shards: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes every stage as Parquet into the shared folder and reads it again, so a lost executor costs a stage's tasks at most.

A row is a document of its own: ids may be null or repeat. Stages read doc_id, text, lang and source; any other columns, whatever their names,
are carried along. A text of any length is handled whole, in its row. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomfold.llm import language, leaks, mixing, shards, simhash
from loomfold.llm.common import free, row_key, settle, table

#: A text of which less than this share of n-grams is known to its language is in none of those learned.
LEAST_KNOWN = 0.2


def _plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns that stages don't read under names that no stage uses, and what gives them their names back."""
    names = [c if c in ("doc_id", "text", "lang", "source") else f"carried{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda found: found.select(*names).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; null texts, those without a letter and those in no such language go.

    Equal texts fare alike, repeated rows all stay; of equally likely languages the first is told, which does not change what stays. Without
    a row to learn from, all go.
    """
    own, named = _plain(docs)
    found = language.identify(own, language.train(own))
    return named(found.filter((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of smallest id: five-word shingles, similarity 0.8 or more.

    A null id comes after all others; of different texts with one id the one of smallest hash is kept, of rows that repeat id and text any.
    Null texts and texts without a word are one group; a text of fewer than five words is near those of the same words.
    """
    own, named = _plain(docs)
    found = simhash.similar(own, shingle=5, similarity=0.8)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    rows = settle(found.groupBy(F.col("doc_id").alias("dup_id"), F.col("key").alias("dup_key")).agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1"))
    same = own["doc_id"].eqNullSafe(F.col("dup_id")) & (row_key(own) == F.col("dup_key"))
    kept, repeated = own.join(rows, same, "left_anti"), rows.filter("stays")
    if not repeated.isEmpty():
        kept = kept.unionByName(own.join(repeated, same).dropDuplicates(["dup_id", "dup_key"]).select(*own.columns))
    return named(kept)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null texts hold none, rows of equal id and text fare alike, and an empty benchmark drops nothing."""
    own, named = _plain(docs)
    return named(leaks.without_leaks(own, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix takes them; a document taken in part counts whole from half of its words on.

    Each row is taken for itself, whether its id is null or repeated or not; of rows that repeat id, source and text, the first in order of the other columns
    are taken most. Null texts and texts without a word have nothing to take and go; a null source is a source.
    """
    own, named = _plain(docs)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mixing.Mix(own).taken(keyed=True).filter("size > 0").select(F.col("key").alias("mix_key"), copies.alias("mix_copies")).filter("mix_copies > 0")
    taken = settle(taken.groupBy("mix_key").agg(F.sort_array(F.collect_list("mix_copies"), asc=False).alias("mix_each")))
    others = [c for c, kind in own.dtypes if c not in ("doc_id", "source", "text") and "map<" not in kind and "variant" not in kind]
    nth = F.row_number().over(W.partitionBy("mix_key").orderBy(*(others or ["mix_key"])))
    found = own.withColumn("mix_key", row_key(own, "source")).withColumn("mix_nth", nth)
    found = found.join(taken.hint("merge"), "mix_key")  # as the table grows with the documents, at every size alike
    found = found.withColumn("mix_copies", F.get("mix_each", F.col("mix_nth") - 1)).filter("mix_copies > 0")
    return named(found.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_copies"))))


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document of the mix into one of 16 shards of near-equal bytes; copies and equal texts go to one shard, a null text counts as empty."""
    return shards.shard(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: No SQL expresses the fitted model or the iterations; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        free(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
