"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by hash, form one stream of words, cut into blocks of equal numbers of words. Slot i
of the mix maps the point frac(i * golden ratio) through the cumulative targets to a source, so that every stretch
of the schedule is mixed like the whole. Slots are ranked per source; rank r takes block r modulo the source's blocks.
A source's slots end when its quota of words is reached; slots that the points leave short are spread over the whole schedule.

Streams and ranks are prefix sums in two steps (within hash buckets, then over their totals), so no source is sorted in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, row_key, settle

GOLDEN = (5**0.5 - 1) / 2
#: Per-source totals are held by the driver; more sources than this are refused.
MAX_SOURCES = 100_000
WEIGHTS, MOST, CHUNK = (5, 2, 1), 3, 65_536
#: Hash buckets of a source at least, and the rows of a bucket for which there are more.
BUCKETS, BUCKET_ROWS = 512, 65_536


def water_fill(sizes: list[int], weights=WEIGHTS, most: float = MOST) -> list[float]:
    """Shares of the total by weight (the weights repeat); none above most times its size, the excess goes to the others by weight."""
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[k % len(weights)] for k in free)
        share = {k: left * weights[k % len(weights)] / whole for k in free}
        full = [k for k in free if share[k] > most * sizes[k]]
        if not full:
            for k in free:
                targets[k] = share[k]
            break
        for k in full:
            targets[k] = float(most * sizes[k])
            left -= targets[k]
        gone = set(full)
        free = [k for k in free if k not in gone]
    return targets


class Mix:
    """The mix of docs (doc_id, source, text): ``sources``, ``schedule()`` and ``taken()``.

    Size is the number of words of the whole text; null and empty texts have 0, and take none. A null source is a source, after
    all others. Sources without words have target 0. Rows that repeat an id are documents of their own. Columns besides
    these three are not read. A text of any length is counted whole, in its row. An empty table gives empty results.

    A document's place in its stream is a hash of its id, source and text, so null ids are spread like others; the buckets of a stream grow with the rows.
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = 1024):
        self.spark, self.most, self.block = docs.sparkSession, most, block
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        self.docs = settle(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit("mix"), row_key(docs, "source")).alias("h"), row_key(docs, "source")))
        rows = self.docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.bucket_bits = max(BUCKETS, sum(r["n"] for r in rows) // BUCKET_ROWS).bit_length() - 1
        # Code points and UTF-8 bytes sort alike; Python compares code points.
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in rows]
        self.sources = [(k, r["source"], r["size"], t) for k, (r, t) in enumerate(zip(rows, water_fill(sizes, weights, most), strict=True))]
        # Whole words; floor keeps within most times the size.
        self.quota = [min(int(math.floor(t + 0.5)), most * s) for _, _, s, t in self.sources]
        self.blocks = [-(-s // block) for _, _, s, _ in self.sources]
        self.slots = [q // s * b + -(-(q % s) // block) if s else 0 for (_, _, s, _), q, b in zip(self.sources, self.quota, self.blocks, strict=True)]

    def _table(self) -> DataFrame:
        rows = [(k, name, size, target, q, b, n) for (k, name, size, target), q, b, n in zip(self.sources, self.quota, self.blocks, self.slots, strict=True)]
        return self.spark.createDataFrame(rows, "sid int, source string, source_size long, target double, quota long, blocks long, slots long")

    def schedule(self) -> DataFrame:
        """One row per slot: slot (the order; numbers have gaps), sid, rank, blk, epoch, first_word, end_word (a range of the source's stream)."""
        total = sum(self.slots)
        edges, at = [], 0.0
        whole = sum(self.quota) or 1
        for q in self.quota:
            at += q / whole
            edges.append(at)

        @F.pandas_udf("int")
        def source_at(u: pd.Series) -> pd.Series:
            return pd.Series(pd.Index(edges).searchsorted(u, side="right").clip(0, len(edges) - 1)).astype("int32")

        points = self.spark.range(total).select(F.col("id").alias("slot"), source_at(F.pmod((F.col("id") + 0.5) * GOLDEN, F.lit(1.0))).alias("sid"))
        points = points.withColumn("chunk", F.expr(f"slot div {CHUNK}"))
        counts = points.groupBy("sid", "chunk").count()
        before = counts.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        in_chunk = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
        ranked = points.withColumn("in_chunk", in_chunk).join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("in_chunk")).alias("rank"))
        had = {r["sid"]: r["count"] for r in counts.groupBy("sid").agg(F.sum("count").alias("count")).collect()}
        # Slots are numbered with room between them, for those of sources that the points leave short.
        room = len(edges) + 1
        ranked = ranked.withColumn("slot", F.col("slot") * room)
        short = [(k, had.get(k, 0), n) for k, n in enumerate(self.slots) if had.get(k, 0) < n]
        if short:
            late = self.spark.createDataFrame(short, "sid int, a long, n long").withColumn("rank", F.explode(F.sequence("a", F.col("n") - 1)))
            nth = F.floor((F.col("rank") - F.col("a")) * F.lit(max(total, 1)) / (F.col("n") - F.col("a")))
            ranked = ranked.unionByName(late.select((nth * room + 1 + F.col("sid")).cast("long").alias("slot"), "sid", "rank"))
        ranked = ranked.join(F.broadcast(self._table()), "sid").filter("rank < slots")  # at most MAX_SOURCES rows
        ranked = ranked.withColumn("blk", F.expr("rank % blocks")).withColumn("epoch", F.expr("rank div blocks")).withColumn("first_word", F.col("blk") * self.block)
        end = F.least(F.col("first_word") + self.block, F.col("source_size"), F.col("quota") - F.col("epoch") * F.col("source_size"))
        return ranked.select("slot", "sid", "rank", "blk", "epoch", "first_word", end.alias("end_word"))

    def streams(self) -> DataFrame:
        """Each document's place in its source's shuffled stream: doc_id, sid, size, source_size, target, first_word."""
        named = self._table().select("sid", F.col("source").alias("source_"), "source_size", "target")
        own = self.docs.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("source_"))).withColumn("bucket", F.shiftrightunsigned("h", 64 - self.bucket_bits))
        before = own.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
        before = before.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        within = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "key").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
        placed = own.withColumn("within", within).join(before.select("sid", "bucket", "before"), ["sid", "bucket"])
        return placed.select("doc_id", "key", "h", "sid", "size", "source_size", "target", (F.col("before") + F.col("within")).alias("first_word"))

    def taken(self, keyed: bool = False) -> DataFrame:
        """One row per row of docs: doc_id, size, source_size, target, taken (words the slots take of it); if keyed, key (row_key with the source) before."""
        more = ["key"] if keyed else []
        if not self.sources:
            return self.docs.select(*more, "doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
        # A block is taken whole by some slots and, by the last slot of its source, up to a word.
        full = F.col("end_word") >= F.least(F.col("first_word") + self.block, F.col("source_size"))
        uses = self.schedule().join(F.broadcast(self._table().select("sid", "source_size")), "sid")
        uses = uses.groupBy("sid", "blk").agg(F.sum(full.cast("long")).alias("whole"), F.max(F.when(~full, F.col("end_word"))).alias("cut"))
        docs = self.streams()
        end = F.col("first_word") + F.col("size")
        pieces = docs.filter("size > 0").withColumn("blk", F.explode(F.sequence(F.expr(f"first_word div {self.block}"), F.expr(f"(first_word + size - 1) div {self.block}"))))
        a, b = F.greatest("first_word", F.col("blk") * self.block), F.least(end, (F.col("blk") + 1) * self.block)
        words = (b - a) * F.col("whole") + F.greatest(F.lit(0), F.least(F.coalesce("cut", F.lit(0)), b) - a)
        got = pieces.join(uses, ["sid", "blk"], "left").groupBy("doc_id", "key", "h", "sid", "first_word", "size", "source_size", "target").agg(F.sum(F.coalesce(words, F.lit(0))).alias("taken"))
        columns = [*more, "doc_id", "size", "source_size", "target", "taken"]
        return got.select(*columns).unionByName(docs.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


def mix(docs: DataFrame, **options) -> DataFrame:
    return Mix(docs, **options).taken()
