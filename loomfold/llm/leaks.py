"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are runs of letters and digits, lower-cased; shingles are SHINGLE of them. A shingle weighs ln(1 + items / items that have it), so what
many items share counts little.

Windows are as long as an item, in words. One that reaches the similarity has at least that part of the item's weight, so it shares
one of the item's rarest shingles, of which any set of more than the rest of the weight will do (ANCHORS of it are taken); only windows
that such a shingle aligns with an item are fingerprinted, each distinct content once. Their weighted SimHash is probed
in 4 blocks of 16 bits: within RADIUS, some block differs in at most RADIUS // 4 bits, and the items' blocks are
listed with all their neighbours that near. Candidates within the radius are verified on their shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, table

SHINGLE, SIMILARITY, RADIUS, ANCHORS = 5, 0.8, 15, 0.5
WORDS = r"[\p{L}\p{N}]+"
#: Rows up to which the items' anchors, weights and the windows found are broadcast (some 30 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))


def _grams(words: Column) -> Column:
    """Hashes of the shingles of hashed words; of fewer words the whole sequence is the one shingle; an empty array if there is no word."""
    at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    every = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, every).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df, to be broadcast if its rows, or what size says they hold, are few enough."""
    n = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] if size is not None else df.count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct items (key, n_words, grams) and their names (key, item_id)."""
    own = benchmark.select("item_id", _words(F.col("text")).alias("words")).select("item_id", F.size("words").alias("n_words"), _grams(F.col("words")).alias("grams"))
    own = settle(own.filter(F.size("grams") > 0).withColumn("key", F.xxhash64("grams")))
    return own.select("key", "n_words", "grams").dropDuplicates(["key"]), own.select("key", "item_id").distinct()


def _weights(items: DataFrame) -> tuple[DataFrame, int]:
    """(gram, weight) of the items' shingles and the weight of any other, in thousandths."""
    n = items.count()
    weight = lambda has: F.round(1000 * F.log1p(F.lit(float(n)) / has)).cast("long")
    own = items.select("key", F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("has"))
    other = items.sparkSession.range(1).select(weight(F.lit(1.0))).first()[0] if n else 0
    return settle(own.select("gram", weight(F.col("has")).alias("weight"))), other


def _anchors(items: DataFrame, weights: DataFrame) -> DataFrame:
    """(gram, n_words, offset): the rarest shingles of each item that make up ANCHORS of its weight, with their places."""
    rows = items.select("key", "n_words", F.posexplode("grams").alias("offset", "gram")).join(_small(weights), "gram")
    each = rows.groupBy("key", "gram").agg(F.sum("weight").alias("weight"), F.max("weight").alias("rank"))
    by = W.partitionBy("key").orderBy(F.desc("rank"), "gram").rowsBetween(W.unboundedPreceding, -1)  # as many rows as an item has words
    each = each.withColumn("before", F.coalesce(F.sum("weight").over(by), F.lit(0))).withColumn("whole", F.sum("weight").over(W.partitionBy("key")))
    kept = each.filter(F.col("before") <= ANCHORS * F.col("whole")).select("key", "gram")
    return settle(rows.join(kept, ["key", "gram"], "left_semi").select("gram", "n_words", "offset").distinct())


def _bags(windows: DataFrame, keys: list[str], weights: DataFrame, other: int) -> DataFrame:
    """windows (keys, n_words, grams) as (keys, n_words, gram, times, weight)."""
    rows = windows.select(*keys, "n_words", F.explode("grams").alias("gram")).groupBy(*keys, "n_words", "gram").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(_small(weights), "gram", "left").withColumn("weight", F.coalesce("weight", F.lit(other)))


def _prints(bags: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted SimHash and whole weight of each bag."""
    bit = lambda b: F.shiftrightunsigned("gram", b).bitwiseAND(1)
    sums = [F.sum(F.when(bit(b) == 1, F.col("weight") * F.col("times")).otherwise(-F.col("weight") * F.col("times"))).alias(f"b{b}") for b in range(64)]
    out = bags.groupBy(*keys, "n_words").agg(F.sum(F.col("weight") * F.col("times")).alias("whole"), *sums)
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out.select(*keys, "n_words", "whole", fp.alias("fp"))


def _block(k: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF).cast("int")


def _near(prints: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Pairs of equal length and of fingerprints within radius: (k1, k2, key, whole, item_whole)."""
    masks = F.array(*[F.lit(sum(1 << b for b in bits)) for n in range(radius // 4 + 1) for bits in combinations(range(16), n)])
    blocks = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(k).alias("value")) for k in range(4)])).alias("x")
    index = items.select("key", "n_words", F.col("whole").alias("item_whole"), F.col("fp").alias("item_fp"), blocks)
    index = index.withColumn("mask", F.explode(masks)).select("key", "n_words", "item_whole", "item_fp", F.col("x.block").alias("block"), F.col("x.value").bitwiseXOR(F.col("mask")).alias("value"))
    probes = prints.select("k1", "k2", "n_words", "whole", "fp", blocks).select("k1", "k2", "n_words", "whole", "fp", "x.*")
    # Merged, as the planner takes the exploded lists for as small as the items and would broadcast them.
    near = probes.join(index.hint("merge"), ["n_words", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    return near.select("k1", "k2", "key", "whole", "item_whole").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per distinct document (doc_id, text_hash) and item it holds: doc_id, text_hash, item_id, start_word, n_words, similarity.

    The best window is told, of equal ones the first that anchors align. An item of fewer than SHINGLE words is one shingle, its whole
    sequence, and so is a text: they match if they are equal. Null texts and texts without a word hold and match nothing. Items of equal words are each told; rows of docs that repeat are told once. Null ids are ids like any other. A text of any length is cut whole, in its row. Other columns
    are not read. An empty table on either side gives none.
    """
    items, names = _items(benchmark)
    weights, other = _weights(items)
    own = _keyed(docs)
    words = own.select("doc_id", "text_hash", _words(F.col("text")).alias("words"))
    places = words.select("doc_id", "text_hash", F.size("words").alias("size"), F.posexplode(_grams(F.col("words"))).alias("at", "gram"))
    found = places.join(_small(_anchors(items, weights)), "gram")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("size") - F.col("n_words")))
    window = F.struct(start.alias("start_word"), F.least("n_words", "size").alias("length"), "n_words")
    found = settle(found.groupBy("doc_id", "text_hash").agg(F.collect_set(window).alias("windows")))
    # The texts of the documents found are read again, those of the others are not cut into words.
    sought = found.select(F.col("doc_id").alias("doc_id_"), F.col("text_hash").alias("text_hash_"), "windows")
    again = own.join(_small(sought, 1 + F.size("windows")), F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_")))
    # Words are a column of their own: nested into _grams they would be cut anew for each shingle.
    again = again.select("doc_id", "text_hash", "windows", _words(F.col("text")).alias("words"))
    again = again.select("doc_id", "text_hash", "windows", _grams(F.col("words")).alias("grams")).withColumn("w", F.explode("windows"))
    held = F.slice("grams", F.col("w.start_word") + 1, F.greatest(F.lit(1), F.col("w.length") - (SHINGLE - 1)))
    held = again.select("doc_id", "text_hash", "w.start_word", "w.n_words", held.alias("grams"))
    held = settle(held.withColumns({"k1": F.xxhash64("grams"), "k2": F.xxhash64("grams", F.lit(1))}))
    contents = held.select("k1", "k2", "n_words", "grams").dropDuplicates(["k1", "k2", "n_words"])
    bags = settle(_bags(contents, ["k1", "k2"], weights, other))
    item_bags = settle(_bags(items, ["key"], weights, other))
    near = settle(_near(_prints(bags, ["k1", "k2"]), _prints(item_bags, ["key"]), radius))
    both = near.join(bags.select("k1", "k2", "gram", "times", "weight").distinct(), ["k1", "k2"]).join(item_bags.select("key", "gram", F.col("times").alias("item_times")), ["key", "gram"])
    shared = both.groupBy("k1", "k2", "key", "whole", "item_whole").agg(F.sum(F.least("times", "item_times") * F.col("weight")).alias("shared"))
    ratio = F.col("shared") / (F.col("whole") + F.col("item_whole") - F.col("shared"))
    alike = settle(shared.select("k1", "k2", "key", ratio.alias("similarity")).filter(F.col("similarity") >= similarity))
    best = held.drop("grams").distinct().join(alike, ["k1", "k2"]).groupBy("doc_id", "text_hash", "key")
    best = best.agg(F.min(F.struct((-F.col("similarity")).alias("less"), "start_word", "n_words")).alias("b"))
    return best.join(names, "key").select("doc_id", "text_hash", "item_id", "b.start_word", F.col("b.n_words").alias("n_words"), (-F.col("b.less")).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; all columns stay."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("leak_doc_id"), F.col("text_hash").alias("leak_text_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("leak_doc_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("leak_text_hash"))
    return docs.join(_small(settle(bad)), same, "left_anti")


def query(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
