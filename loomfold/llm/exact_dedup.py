"""Exact deduplication by deterministic block naming.

A text, without the characters of ``SPACE``, is cut into blocks of a fixed number of code points. Every distinct
block gets an integer name by its place in a sort; then adjacent pairs of names are named the same way, level
by level, until one name is left. Two documents have equal texts exactly if they have the same number of blocks
and the same last name: names are given to contents, never to hashes, so they cannot collide. A row is known by its id, the
SHA-256 of its text and its length, as ids may repeat.

The content of the blocks is shuffled once, combined on the map side. Occurrences carry a 64-bit hash of their
block instead of the block and pick up its name by that hash. This is exact because blocks of equal hash are
looked for among the named contents first; any there are get their names by a join on the content itself.
Every level above the first moves pairs of integers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free, settle

KEY = ["doc_id", "text_sha", "n_points"]


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256)).alias("text_sha")


def _hash(c: Column) -> Column:
    return F.xxhash64(c)


def _blocks(docs: DataFrame, block: int, hashed) -> DataFrame:
    norm = F.regexp_replace("text", SPACE + "+", "")
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("doc_id", _sha(F.col("text")), F.length("text").alias("n_points"), F.posexplode_outer(cut).alias("i", "block"))
    own = own.select(*KEY, F.coalesce("i", F.lit(0)).cast("long").alias("i"), F.coalesce("block", F.lit("")).alias("block"))
    return own.withColumn("h", hashed(F.col("block")))


def _named(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """A number for each row by its place in the sort; the partitions are a function of the rows, so a task that runs again numbers alike."""
    return distinct.sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block: int = 2048, hashed=_hash, spent: list | None = None) -> DataFrame:
    """One row per distinct (doc_id, text_sha, n_points) of docs: width and name, together its collision-free identity.

    A null text counts as empty; an empty text is one empty block. Null ids are a value like any other. Rows that
    repeat an id and a text are one row here. A text of any length is cut whole, in its row; its blocks are rows of their own. Columns besides doc_id and text are not
    read. An empty table gives none. The stored tables that the result reads are appended to spent, for free().
    """
    spent = [] if spent is None else spent
    blocks = _blocks(docs, block, hashed)
    names = settle(_named(blocks.select("h", "block").distinct(), ["h", "block"]).select("h", "name"))
    clash = settle(names.groupBy("h").count().filter("count > 1").select("h"))
    spent += [names, clash]
    occurrences = blocks.select(*KEY, "i", "h")
    if clash.isEmpty():
        level = occurrences.join(names, "h")
    else:  # different blocks of equal hash: these, and only these, get their names by their content
        odd = settle(blocks.join(clash, "h", "left_semi"))
        by_content = settle(_named(odd.select("block").distinct(), ["block"]).select("block", (-1 - F.col("name")).alias("name")))
        spent += [odd, by_content]
        level = occurrences.join(clash, "h", "left_anti").join(names, "h").select(*KEY, "i", "name").unionByName(odd.join(by_content, "block").select(*KEY, "i", "name"))
    done, width = None, 1
    while True:
        name = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = settle(level.groupBy(*KEY, F.floor(F.col("i") / 2).alias("i")).agg(name(0).alias("a"), name(1).alias("b")))
        spent.append(pairs)
        alone = (F.col("i") == 0) & F.col("b").isNull()
        ended = pairs.filter(alone).select(*KEY, F.lit(width).cast("long").alias("width"), F.col("a").alias("name"))
        done = ended if done is None else done.unionByName(ended)
        rest = pairs.filter(~alone)
        if rest.isEmpty():
            return done
        named = settle(_named(rest.select(F.col("a").alias("a_"), F.col("b").alias("b_")).distinct(), ["a_", "b_"]))
        spent.append(named)
        level = rest.join(named, (F.col("a") == F.col("a_")) & F.col("b").eqNullSafe(F.col("b_"))).select(*KEY, "i", "name")
        width *= 2


def exact_dedup(docs: DataFrame, block: int = 2048, hashed=_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row of most code points stays, then that of the smallest doc_id (null last), then that of the least SHA-256; of rows
    that repeat both id and text one stays, as a row number given when they are stored tells. Null and empty texts are equal to texts of
    whitespace alone. A text of any length is compared whole. An empty table gives an empty result.
    """
    spent: list[DataFrame] = []
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", _sha(text), F.length(text).alias("n_points"), F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256).alias("text_sha256"))
    ids = identities(docs, block, hashed, spent).select(*[F.col(k).alias(k + "_") for k in KEY], "width", "name")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(k + "_"))
    rows = settle(own.join(ids, same).select(*KEY, "text_sha256", "width", "name", F.monotonically_increasing_id().alias("row")))
    free(*spent)
    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha", "row"))
    groups = settle(rows.groupBy("width", "name").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")).filter("group_size > 1"))
    found = rows.join(groups, ["width", "name"], "left")
    keep = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = F.col("first").isNull() | (F.col("row") == F.col("first.row"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


ORACLE_SQL = """
with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, row_number() over w = 1 as kept, sha256(norm) as text_sha256
from d window w as (partition by norm order by length(text) desc, doc_id nulls last, sha256(text))
"""
