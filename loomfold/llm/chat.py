"""Chat formatting by perspective rotation.

Every participant of a conversation gets the dialogue rendered from its own side: its turns as ``assistant``, those
of all others as ``user`` with their names, system turns as ``system``, and a mask of the character ranges to train on.

A long dialogue is rendered in parts of PART turns at most, so no conversation has to fit into one row: of PART consecutive turn
numbers, cut again where numbers repeat or are null. Joined in the order of part and piece they are the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

PART = 512
START, END = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    """Without character pairs that open a control mark."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _pieces(own: DataFrame, part: int) -> DataFrame:
    """own with piece: within a conversation and part, each part turns in the order of turn, role and text are one.

    A part has more rows than numbers only where numbers repeat or are null. Those alone are ranked, and in no single task, as one of them may hold
    most rows: dealt by ranges of the order, equal rows among them by a row number, ranked within a range, and moved on by what the ranges before hold.
    """
    which = ["conv_id", "part"]
    large = settle(own.groupBy(*which).count().filter(F.col("count") > part).select(F.col("conv_id").alias("conv_id_"), F.col("part").alias("part_")))
    if large.isEmpty():
        return own.withColumn("piece", F.lit(0).cast("long"))
    is_large = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("part") == F.col("part_"))
    order = ["turn", "role", "text", "row"]
    dealt = own.join(large, is_large, "left_semi").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*which, *order)
    dealt = settle(dealt.withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy(*which, "range").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy(*which).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("conv_id").alias("conv_id_"), F.col("part").alias("part_"), F.col("range").alias("range_"), before.alias("before"))
    nth = F.row_number().over(W.partitionBy(*which, "range").orderBy(*order)) - 1
    ranked = dealt.withColumn("nth", nth).join(counts, is_large & (F.col("range") == F.col("range_")))
    ranked = ranked.withColumn("piece", F.floor((F.col("before") + F.col("nth")) / part).cast("long"))
    rest = own.join(large, is_large, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    return rest.unionByName(ranked.select(*rest.columns))


def rotate(conversations: DataFrame, system=("system",), part: int = PART) -> DataFrame:
    """One row per conversation, participant and part: conv_id, speaker, part, piece, n_turns, text, mask.

    mask is an array of (start, end) character ranges of text, from 0: what the assistant's turns say, with their end mark. A
    null role is the participant ``unknown``; a null or empty text is an empty turn; null turns come first, in part -1. Turns of
    equal number stand in the order of role and text; rows that repeat are repeated turns; null conversation ids are one
    conversation. A conversation of system turns alone has no participant and no row. A text of any length is one turn, rendered whole. Other columns are not read. An empty table gives none.
    """
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), _safe(F.coalesce("text", F.lit(""))).alias("text"))
    own = own.withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long"))
    own = _pieces(own, part)
    parts = own.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = own.filter(~F.col("role").isin(*system)).select(F.col("conv_id").alias("conv_id_"), F.col("role").alias("speaker")).distinct()
    rows = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv_id_"))).drop("conv_id_")

    def rendered(t: Column) -> Column:
        mine = t["role"] == F.col("speaker")
        head = F.when(mine, F.lit("assistant")).when(t["role"].isin(*system), t["role"]).otherwise(F.concat(F.lit("user name="), _safe(t["role"])))
        return F.struct(F.concat(F.lit(START), head, F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), mine.alias("mine"))

    rows = rows.withColumn("said", F.transform("turns", rendered))
    rows = rows.withColumn("lengths", F.transform("said", lambda s: F.length(s["head"]) + F.length(s["body"]) + 1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("lengths", zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
    ranges = F.zip_with("said", starts, lambda s, at: F.when(s["mine"], F.struct((at + F.length(s["head"])).alias("start"), (at + F.length(s["head"]) + F.length(s["body"])).alias("end"))))
    text = F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return rows.select("conv_id", "speaker", "part", "piece", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), F.filter(ranges, lambda r: r.isNotNull()).alias("mask"))


def digest(rendered: DataFrame) -> DataFrame:
    """With the mask as a string of start-end pairs."""
    pairs = F.transform("mask", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return rendered.withColumn("mask", F.array_join(pairs, ","))


ORACLE_SQL = f"""
with t as (select conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text, coalesce(floor(turn / {PART})::bigint, -1) as part from conversations),
o as (select *, ((row_number() over (partition by conv_id, part order by turn nulls first, role, text) - 1) // {PART})::bigint as piece from t),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
r as (select t.conv_id, speaker, part, piece, turn, role, text, role = speaker as mine,
    '{START}' || case when role = speaker then 'assistant' when role = 'system' then 'system' else 'user name=' || replace(role, '<|', '< |') end || chr(10) as head, text || '{END}' as body,
    row_number() over (partition by t.conv_id, speaker, part, piece order by turn nulls first, role, text) as n
  from o as t join s on t.conv_id is not distinct from s.conv_id),
p as (select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, speaker, part, piece order by n rows between unbounded preceding and 1 preceding), 0)::bigint as start from r)
select conv_id, speaker, part, piece, count(*)::bigint as n_turns, string_agg(head || body || chr(10), '' order by n) as text,
  coalesce(string_agg((start + length(head))::varchar || '-' || (start + length(head) + length(body))::varchar, ',' order by n) filter (where mine), '') as mask
from p group by conv_id, speaker, part, piece
"""
