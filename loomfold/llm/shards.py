"""Sharding by minimax contiguous partition.

Equal texts form atomic groups; groups stand in the order of a 64-bit hash of their text. The smallest capacity
with which at most n shards hold all groups in that order is found by binary search, each try checked greedily.

The driver never holds the groups. It holds byte sums over units, intervals of hash space: at first the 65,536
values of the top 16 bits. Wherever a try or a cut ends inside a unit of several groups, that unit is opened: the
sums of its 65,536 parts are gathered, at most MAX_OPEN units at once, and the search is done anew. It ends when every
cut tried lies between known groups, so the capacity and cuts are exact while what is gathered stays bounded.

With the capacity known, each cut goes where what is left is split most evenly, within the capacity and such
that the rest still fits: a group above the mean then doesn't leave other shards empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

#: Rows that a lane of a shard numbers, about.
STEP, MAX_OPEN, LANE = 16, 64, 100_000


class Units:
    """Byte sums of intervals of hash space in order; at shift s an interval holds the hashes of equal ``h >> s``."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.units = self._sums(groups, 64 - STEP)
        self._index()

    @staticmethod
    def _sums(groups: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
        """(first hash, shift, bytes, groups) of every unit that has groups."""
        part = F.shiftright("h", shift) if shift else F.col("h")
        rows = groups.groupBy(part.alias("part")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["part"] << shift, shift, r["bytes"], r["n"]) for r in rows)

    def _index(self) -> None:
        self.ends = list(accumulate(u[2] for u in self.units))
        self.total = self.ends[-1] if self.ends else 0
        self.needs: set[int] = set()

    def start(self, k: int) -> int:
        return self.ends[k - 1] if k else 0

    def around(self, at: int) -> tuple[int, int]:
        """The last boundary at or before a byte position and the first at or after it, as far as units tell."""
        k = bisect_left(self.ends, at)
        if k >= len(self.ends):
            return self.total, self.total
        if at in (self.ends[k], self.start(k)):
            return at, at
        if self.units[k][3] > 1:
            self.needs.add(k)
        return self.start(k), self.ends[k]

    def open(self) -> None:
        """Opens the heaviest units that were needed."""
        chosen = sorted(self.needs, key=lambda k: -self.units[k][2])[:MAX_OPEN]
        found = []
        for shift in {self.units[k][1] for k in chosen}:
            parts = [self.units[k][0] >> shift for k in chosen if self.units[k][1] == shift]
            found += self._sums(self.groups.filter(F.shiftright("h", shift).isin(parts)), shift - STEP)
        self.units = sorted([u for k, u in enumerate(self.units) if k not in set(chosen)] + found)
        self._index()

    def hash_at(self, at: int) -> int:
        """The first hash of the unit that starts at a byte position."""
        k = bisect_right(self.ends, at)
        return self.units[k][0]


def _greedy(units: Units, capacity: int, n: int) -> int:
    """Where n shards of this capacity end when each takes all it can."""
    at = 0
    for _ in range(n):
        at = units.around(at + capacity)[0]
    return at


def _search(units: Units, n: int) -> tuple[int, list[int]]:
    low = max([-(-units.total // n), *(u[2] for u in units.units if u[3] == 1)], default=0)
    high = max(low, units.total)
    while low < high:
        middle = (low + high) // 2
        if _greedy(units, middle, n) >= units.total:
            high = middle
        else:
            low = middle + 1
    capacity, least = low, [units.total]
    for _ in range(n - 1):  # before these, the shards that follow cannot hold the rest
        least.append(max(0, units.around(max(0, least[-1] - capacity))[1]))
    least = least[::-1]
    cuts, at = [], 0
    for k in range(n - 1):
        wanted = at + (units.total - at) / (n - k)
        options = [x for x in units.around(round(wanted)) if max(least[k], at) <= x <= at + capacity]
        at = min(options, key=lambda x: abs(x - wanted)) if options else min(max(least[k], at), units.total) if least[k] > wanted else units.around(at + capacity)[0]
        cuts.append(at)
    return capacity, cuts


def minimax_cuts(groups: DataFrame, n: int) -> tuple[int, list[int]]:
    """The least capacity of n contiguous shards over groups (h, bytes), and the first hash of each shard after the first.

    Fewer groups than shards leave shards empty; no group at all gives capacity 0 and no cut.
    """
    units = Units(groups)
    while True:
        capacity, cuts = _search(units, n)
        if not units.needs:
            return capacity, [units.hash_at(c) for c in cuts if c < units.total]
        units.open()


def shard(docs: DataFrame, n: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus 1; a null text has none and counts as empty, so null and empty texts are one
    group. Groups are never split. Slots are numbered from 0 without gaps in each shard; rows that repeat are all
    placed. A text of any length is measured whole and moved nowhere. Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    groups = settle(own.groupBy("h").agg(F.sum("size").alias("bytes")))
    _, cuts = minimax_cuts(groups, n)
    place = F.lit(0)
    for c in cuts:
        place = place + (F.col("h") >= F.lit(c)).cast("int")
    rows = settle(own.withColumn("shard", place))
    # Numbered in lanes, so that no shard is sorted in one task; the lanes grow with the rows.
    lanes = max(64, rows.count() // (n * LANE))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", "h"), F.lit(lanes)).cast("int"))
    before = rows.groupBy("shard", "lane").count().withColumn("before", F.sum("count").over(W.partitionBy("shard").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("shard", "lane", F.coalesce("before", F.lit(0)).alias("before"))
    in_lane = F.row_number().over(W.partitionBy("shard", "lane").orderBy("doc_id", "h")) - 1
    placed = rows.withColumn("in_lane", in_lane).join(F.broadcast(before), ["shard", "lane"])  # a row for LANE documents, about
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("in_lane")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
