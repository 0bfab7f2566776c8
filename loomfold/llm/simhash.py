"""SimHash near-duplicate detection by the generalised pigeonhole principle.

Fingerprints are cut into partitions of correlated bits. A query x probes partition i within t_i(x) differing bits; if
the t_i(x) + 1 sum to radius + 1, every fingerprint within the radius is within t_i(x) of x in some partition, so no link is
lost. The t_i(x), from -1 (no probe) up, come from a dynamic program that minimises the candidates and probes expected
of x, from counts of all fingerprints by partition value. Candidates are verified on the whole fingerprint.

Distribution: a partition's values are split into cells by their leading bits. A fingerprint is in one cell of each partition as
an entry, and goes as a query to the cells within its threshold. Cells of more than CELL entries are split into
sub-cells of entries and queries, each pair of which is a task of its own: no task grows with a dense cell. A task emits
a spanning forest of the links it finds, not the links, so a group of n yields fewer than n rows from each task.
Components come from alternating large and small stars over those edges.

With a similarity of shingle bags, a radius is no bound: at 0.8 a seventh of the bits differ, and a radius of as much holds a fixed share of all pairs, however
many partitions. So the search by radius proposes only the pairs that it finds at constant cost (RADIUS), and bands of least hashes propose the others: each bag has
BANDS names, each of ROWS least hashes, and a pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS: 0.998 at 0.8, 0.12 at 0.5, below 10^-5 at 0.15.
A document is proposed with the first of each of its names, so proposals grow with the documents alone. The components of what is proposed are
groups, whose pairs are all compared by the Jaccard similarity of their bags. Bags are shipped once, to a task for many groups; a group of more than
BLOCK bytes or MOST nodes is cut into blocks. Each block is resolved for itself, then the closest proposed pairs between parts of different blocks are
verified, and then the nodes outside the group's largest part are compared with all others: only they meet every block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, possible, row_key, settle, text_batches

SEED, BITS = 42, 64
#: Fingerprints, of smallest hash, from which the grouping of bits is fitted; it affects speed only.
SAMPLE = 4096
#: Entries of a cell beyond which it is split; candidates held at once; candidates that a probe costs as much as.
CELL, CHUNK, PROBE_COST = 1 << 18, 1 << 18, 2.0
#: Leading bits of a partition's values that are counted, at most: with one lane, with more.
MOST_BITS = 16, 13
#: Bytes of bags, and nodes, that a task compares; rows of a small table that is broadcast.
BLOCK, MOST, SMALL = 2 << 20, 2048, 100_000
#: Search by radius beside the bands of a similarity; names of a bag and least hashes of a name.
RADIUS, BANDS, ROWS = 3, 34, 8
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, repeats included; the whole sequence if it is shorter; none without a word."""
    words = (text or b"").lower().split()  # on bytes, both know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    k = min(shingle, len(words))
    starts = [0, *ends[: len(words) - k]]
    return np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)], np.uint64)


def numbered(h: np.ndarray) -> np.ndarray:
    """The hashes sorted, each repeat of one hashed anew with its number: the bag as a set."""
    s = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    nth = (np.arange(len(s)) - np.repeat(first, np.diff([*first, len(s)]))).astype(np.uint64)
    return np.sort(np.where(nth > 0, _mixed(s + nth * np.uint64(0xD6E8FEB86659FD93), 1), s))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another hash of each hash (the finaliser of SplitMix64)."""
    z = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(h: np.ndarray) -> int:
    """Bit by bit, 1 if set in over half of the hashes; as a signed number."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(h, len(h) // 65_536 + 1):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id and fp0 to fp{lanes-1}, 64 bits each, of every row of docs (doc_id, text); lanes beyond the first hash the shingle hashes anew."""
    names = [f"fp{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").cast(pa.binary()):
                h = shingle_hashes(text.as_py(), shingle)
                found.append([simhash(_mixed(h, k) if k else h) for k in range(lanes)])
            columns = np.array(found, np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(columns[:, k]) for k in range(lanes)]], ["doc_id", *names])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return text_batches(own).mapInArrow(run, T.StructType([own.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names]]))


def names_of(h: np.ndarray) -> np.ndarray:
    """The BANDS names of a bag of hashes, none for an empty one: hashes of ROWS least products each."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(h), 1024):
        np.minimum(least, (h[k : k + 1024, None] * _FACTORS).min(axis=0), out=least)
    least, out = least.reshape(BANDS, ROWS), _mixed(np.arange(BANDS, dtype=np.uint64), 1)
    for k in range(ROWS):
        out = _mixed(out ^ least[:, k], 1)
    return out.view(np.int64)


def _bag_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key (of doc_id and text), node (of the bag of shingles), fp0 (fingerprint) and names of the numbered bag, of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, names = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                h = numbered(shingle_hashes(text.as_py(), shingle))
                node.append(int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64)))
                fp.append(simhash(h))
                names.append(names_of(h))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(names, pa.list_(pa.int64()))], ["doc_id", "key", "node", "fp0", "names"])

    own = docs.select("doc_id", row_key(docs), F.col("text").cast("string").alias("text"))
    more = [T.StructField(n, T.LongType()) for n in ("key", "node", "fp0")]
    return text_batches(own).mapInArrow(run, T.StructType([own.schema["doc_id"], *more, T.StructField("names", T.ArrayType(T.LongType()))]))


class Plan:
    """How fingerprints are cut, and what each value of each partition costs to probe."""

    def __init__(self, bits: list[list[int]], radius: int, cell_bits: int):
        self.bits, self.radius, self.cell_bits = bits, radius, cell_bits
        self.most = min(radius, 4 if radius > 3 else radius)
        # The least that the thresholds must be able to sum to.
        self.most = max(self.most, -(-(radius + 1) // len(bits)) - 1)

    def values(self, fp: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(fp), np.int64)
        for b in self.bits[part]:
            out = (out << 1) | ((fp >> np.int64(b)) & 1)
        return out

    def weigh(self, counts: list[np.ndarray]) -> None:
        """Costs by partition, threshold + 1 and leading bits of the value."""
        self.costs, self.splits = [], []
        for bits, count in zip(self.bits, counts, strict=True):
            known, width = len(count).bit_length() - 1, len(bits)
            at, within, rows = np.arange(len(count)), np.zeros(len(count)), [np.zeros(len(count))]
            for t in range(self.most + 1):
                for m in _masks(known, t):
                    within = within + count[at ^ m]
                here, there = (sum(comb(w, x) for x in range(t + 1)) for w in (known, width))
                rows.append(within * (there / here / 2 ** (width - known)) + PROBE_COST * there)
            self.costs.append(np.array(rows, np.float32))
            self.splits.append((-(-count.reshape(1 << self.cell_bits, -1).sum(axis=1) // CELL)).clip(1))

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """The cheapest t_i of each fingerprint, by dynamic programming over partitions and the sum so far."""
        n, whole = len(values[0]), self.radius + 1
        best, picks = [np.zeros(n)] + [np.full(n, np.inf)] * whole, []
        for bits, cost, v in zip(self.bits, self.costs, values, strict=True):
            own = cost[:, v >> (len(bits) - cost.shape[1].bit_length() + 1)]
            new, pick = [], np.zeros((whole + 1, n), np.int8)
            for total in range(whole + 1):
                options = np.array([best[total - s] + own[s] for s in range(min(total, self.most + 1) + 1)])
                pick[total] = options.argmin(axis=0)
                new.append(options.min(axis=0))
            best = new
            picks.append(pick)
        out, left, rows = np.zeros((len(values), n), np.int8), np.full(n, whole), np.arange(n)
        for part in range(len(values) - 1, -1, -1):
            s = picks[part][left, rows]
            out[part] = s - 1
            left = left - s
        return out


def _masks(width: int, ones: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), ones)]


def _grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width, each grown from a free bit by the free bits that correlate most with it."""
    if len(sample) < 2:
        sample = np.arange(4, dtype=np.int64)
    bits = ((sample[:, None] >> np.arange(BITS)) & 1).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    alike, free, out = np.abs(bits.T @ bits / norm[:, None] / norm), list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: alike[b, free].sum())]
        free.remove(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: alike[b, group].sum()))
            free.remove(group[-1])
        out.append(group)
    return out


def _n_parts(n: int, radius: int) -> int:
    """The number of partitions with which probing costs least if all values are equally common: fewer and wider ones the more there are."""

    def cost(parts: int) -> float:
        total = 0.0
        for k in range(parts):
            t, width = (radius + 1) // parts + (k < (radius + 1) % parts) - 1, BITS // parts
            probes = sum(comb(width, x) for x in range(t + 1))
            total += probes * (PROBE_COST + n / 2.0**width)
        return total

    return min((2, 3, 4), key=cost) if radius <= 12 else 4


def make_plans(nodes: DataFrame, n: int, radius: int, lanes: list[str]) -> list[Plan]:
    """A plan for each lane, from one sample and one pass over all values."""
    sample = nodes.select(*lanes).orderBy(F.xxhash64(*lanes), *lanes).limit(SAMPLE).toPandas()
    parts, cell_bits = _n_parts(n, radius), min(14, max(2, (n >> 17).bit_length()))
    plans = [Plan(_grouped_bits(sample[x].to_numpy(np.int64), parts), radius, cell_bits) for x in lanes]
    most = max(MOST_BITS[len(lanes) > 1], cell_bits)  # the counts of all lanes are held by the driver
    sizes = [1 << min(len(b), most) for b in plans[0].bits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[np.zeros(s, np.int64) for s in sizes] for _ in lanes]
        for batch in batches:
            for lane, plan in enumerate(plans):
                fp = batch.column(lane).to_numpy()
                for k, bits in enumerate(plan.bits):
                    total[lane][k] += np.bincount(plan.values(fp, k) >> max(0, len(bits) - most), minlength=sizes[k])
        for lane, own in enumerate(total):
            for k, t in enumerate(own):
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(at), lane * parts + k, np.int32)), "value": pa.array(at.astype(np.int32)), "n": pa.array(t[at])})

    rows = nodes.select(*lanes).mapInArrow(run, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in lanes]
    at, value, n_ = (rows.column(c).to_numpy() for c in ("part", "value", "n"))
    for part in np.unique(at).tolist():
        counts[part // parts][part % parts][value[at == part]] = n_[at == part]
    for plan, own in zip(plans, counts, strict=True):
        plan.weigh(own)
    return plans


def _dealt(nodes: DataFrame, plans, lanes: list[str]) -> DataFrame:
    """Entries (t = -1) and queries of each cell: lane, part, cell, i, j (of its sub-cells), t, node and the lane's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lane, p in enumerate(plans.value):
                fp, out = batch.column(lanes[lane]).to_numpy(), []
                near = [_masks(p.cell_bits, t) for t in range(min(p.most, p.cell_bits) + 1)]
                values = [p.values(fp, k) for k in range(len(p.bits))]
                t = p.thresholds(values)
                for k, v in enumerate(values):
                    prefix = v >> (len(p.bits[k]) - p.cell_bits)
                    rows = np.arange(len(fp))
                    out.append((k, prefix, rows, np.full(len(fp), -1)))
                    for d, masks in enumerate(near):
                        rows = np.flatnonzero(t[k] >= d)
                        for m in masks:
                            out.append((k, prefix[rows] ^ m, rows, t[k][rows]))
                for k, cell, rows, own in out:
                    s = p.splits[k][cell].astype(np.int64)
                    mine = (fp[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % s
                    rep = np.repeat(np.arange(len(rows)), s)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(s) - s, s)
                    entry = own[rep] < 0
                    i, j = np.where(entry, mine[rep], other), np.where(entry, other, mine[rep])
                    columns = [np.full(len(rep), x, np.int32) for x in (lane, k)] + [x.astype(np.int32) for x in (cell[rep], i, j, own[rep])]
                    node = batch.column("node").take(pa.array(rows[rep]))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), node, pa.array(fp[rows[rep]])], ["lane", "part", "cell", "i", "j", "t", "node", "fp"])

    return nodes.select("node", *lanes).mapInArrow(run, "lane int, part int, cell int, i int, j int, t int, node long, fp long")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number it would count those of its absolute value


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label after the links a-b; label[x] is the root of x, its smallest member."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _candidates(plan: Plan, part: int, cell: int, entry: np.ndarray, query: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries and of the entries within their thresholds, some CHUNK at a time."""
    width = len(plan.bits[part])
    low = width - plan.cell_bits
    v = plan.values(entry, part) & ((1 << low) - 1)
    order = np.argsort(v, kind="stable")
    sorted_v = v[order]
    table = np.searchsorted(sorted_v, np.arange((1 << low) + 1)) if low <= 20 else None
    q = plan.values(query, part)
    prefix = q >> low
    by = {}
    for key in np.unique(np.stack([prefix, t], 1), axis=0):
        by.setdefault(int(key[0]), []).append((int(key[1]), np.flatnonzero((prefix == key[0]) & (t == key[1]))))
    for p, groups in by.items():
        first = bin(p ^ cell).count("1")
        for most, rows in groups:
            for d in range(most - first + 1):
                for m in _masks(low, d):
                    u = (q[rows] & ((1 << low) - 1)) ^ m
                    a, b = (table[u], table[u + 1]) if table is not None else (np.searchsorted(sorted_v, u), np.searchsorted(sorted_v, u, "right"))
                    hit = b > a
                    if not hit.any():
                        continue
                    rows_, a, size = rows[hit], a[hit], (b - a)[hit]
                    ends = np.cumsum(size)
                    cuts = np.searchsorted(ends, np.arange(CHUNK, ends[-1] + CHUNK, CHUNK))
                    at = 0
                    for c in [*np.unique(cuts), len(size)]:
                        stop = min(c + 1, len(size))
                        if stop <= at:
                            continue
                        s = size[at:stop]
                        # A single query of very many entries is at most a sub-cell: CELL candidates.
                        x = np.repeat(rows_[at:stop], s)
                        e = order[np.repeat(a[at:stop], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)]
                        at = stop
                        yield x, e


def _links(plan: Plan, part: int, cell: int, entry: np.ndarray, query: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The root of each entry and query under the links between queries and entries."""
    n = len(entry)
    label = np.arange(n + len(query))
    for x, e in _candidates(plan, part, cell, entry, query, t):
        differ = _ones(query[x] ^ entry[e])
        ok = (differ <= plan.radius) & (label[n + x] != label[e])
        x, e = x[ok], e[ok]
        if len(x):
            label = _merge(label, e, n + x)
    return label


def _spanning(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the pairs a-b make up a spanning forest of the least far; ties go to the smaller numbers, in every task alike."""
    order = np.lexsort((b, a, far))
    a, b = a[order], b[order]
    at, kept, label = np.arange(len(a)), [np.empty(0, np.int64)], np.arange(max(a.max(), b.max()) + 1 if len(a) else 0)
    while len(at := at[label[a[at]] != label[b[at]]]):
        best = np.full(len(label), len(a))
        np.minimum.at(best, label[a[at]], at)
        np.minimum.at(best, label[b[at]], at)
        use = np.unique(best[best < len(a)])
        kept.append(use)
        label = _merge(label, a[use], b[use])
    return order[np.concatenate(kept)]


def _pairs(plan: Plan, part: int, cell: int, entry: np.ndarray, query: np.ndarray, t: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """A spanning forest of the closest pairs (u, v, far) of nodes (ids of the entries, then of the queries) within the radius."""
    n = len(entry)
    nodes, at = np.unique(ids, return_inverse=True)
    held = np.empty((3, 0), np.int64)
    for x, e in _candidates(plan, part, cell, entry, query, t):
        far = _ones(query[x] ^ entry[e]).astype(np.int64)
        ok = (far <= plan.radius) & (at[n + x] != at[e])
        if not ok.any():
            continue
        a, b = at[n + x[ok]], at[e[ok]]
        held = np.concatenate([held, np.stack([np.minimum(a, b), np.maximum(a, b), far[ok]])], axis=1)
        if held.shape[1] > CHUNK:
            held = held[:, _spanning(*held)]
    held = held[:, _spanning(*held)]
    return pd.DataFrame({"u": nodes[held[0]], "v": nodes[held[1]], "far": held[2]})


def forest(nodes: DataFrame, radius: int, direct: bool = False) -> DataFrame:
    """Edges (u, v, far) between nodes (node, fp0, ...) whose components are those of all links, some lane within radius; if direct, edges are links themselves."""
    lanes = [c for c in nodes.columns if c.startswith("fp")]
    plans = nodes.sparkSession.sparkContext.broadcast(make_plans(nodes, nodes.count(), radius, lanes))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        fp, t, node = (own[c].to_numpy(np.int64) for c in ("fp", "t", "node"))
        entries, queries = np.flatnonzero(t < 0), np.flatnonzero(t >= 0)
        if not len(entries) or not len(queries):
            return pd.DataFrame({"u": [], "v": [], "far": []}, dtype=np.int64)
        both = np.concatenate([entries, queries])
        args = plans.value[key[0]], int(key[1]), int(key[2]), fp[entries], fp[queries], t[queries]
        if direct:
            return _pairs(*args, node[both])
        label, ids = _links(*args), node[both]
        # An entry and a query may be the same node.
        far = np.flatnonzero(label != np.arange(len(label)))
        found = pd.DataFrame({"u": ids[far], "v": ids[label[far]], "far": 0})
        return found[found["u"] != found["v"]].drop_duplicates()

    found = _dealt(nodes, plans, lanes).groupBy("lane", "part", "cell", "i", "j").applyInPandas(run, "u long, v long, far long")
    return settle(found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("far").alias("far")))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of every node that has an edge (u, v); roots themselves are left out. A round's tables go when the next has its own."""
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = settle(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        free(edges, least)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        free(large, least)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._loomfold_path = edges._loomfold_path
            return out
        before = now


class Bags:
    """Bags of shingles, each a sorted set of hashes, of which one can be compared with many at once."""

    def __init__(self, bags: list[bytes]):
        self.sizes = np.array([len(b) // 8 for b in bags])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.unique(np.frombuffer(b"".join(bags), np.uint64), return_inverse=True)[1]
        self.marks = np.zeros(len(self.ids), bool)

    def alike(self, one: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the others, as numbers of bags, have the similarity with one; a bag of nothing has it with none."""
        size = self.sizes[others]
        own = self.ids[self.starts[one] : self.starts[one] + self.sizes[one]]
        self.marks[own] = True
        where = np.repeat(self.starts[others] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        hits = np.concatenate([[0], np.cumsum(self.marks[self.ids[where]])])
        self.marks[own] = False
        ends = np.cumsum(size)
        both = hits[ends] - hits[ends - size]
        return (both > 0) & (both >= similarity * (self.sizes[one] + size - both) - 1e-9)


def resolved(bags: Bags, similarity: float) -> np.ndarray:
    """The root of each bag under all pairs of the similarity: from each bag reached, those not reached yet are looked at."""
    n = len(bags.sizes)
    label, left = np.arange(n), np.arange(n)
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            hit = bags.alike(front.pop(), left, similarity)
            if hit.any():
                label[left[hit]] = root
                front += left[hit].tolist()
                left = left[~hit]
    return label


def _bags_of(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """members (node, grp, key) with their bag, from the text of the row that key names."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [numbered(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("node"), pa.array(found, pa.binary())], ["grp", "node", "bag"])

    rows = possible(text_batches(docs).select(row_key(docs), F.col("text").cast("string").alias("text")), "key", members, "key").dropDuplicates(["key"])
    return settle(rows.join(members, "key").select("grp", "node", "text").mapInArrow(cut, "grp long, node long, bag binary"))


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) that have the similarity."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [bool(Bags([x.as_py(), y.as_py()]).alike(0, np.array([1]), similarity)[0]) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    x, y = bags.select(F.col("node").alias("u"), F.col("bag").alias("x")), bags.select(F.col("node").alias("v"), F.col("bag").alias("y"))
    return settle(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(alike, "u long, v long"))


def _rooted(df: DataFrame, roots: DataFrame, name: str, as_: str) -> DataFrame:
    return df.join(roots.select(F.col("node").alias(name), F.col("root").alias(as_)), name, "left").withColumn(as_, F.coalesce(as_, name))


def _blocks(size: str = "bytes", n: str = "n"):
    return F.greatest(F.ceil(F.col(size) / BLOCK), F.ceil(F.col(n) / MOST), F.lit(1)).cast("int")


def proposed(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v, far) of nodes (node, fp0, names): a forest of those within the radius, and each node with the first of those that share a name."""
    rows = nodes.select("node", "fp0", F.explode("names").alias("name"))
    first = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp0")).alias("first")).filter("n > 1")
    both = rows.join(first.select("name", F.col("first.node").alias("v"), F.col("first.fp0").alias("fp")), "name").filter("node <> v")
    near = both.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"), F.bit_count(F.col("fp0").bitwiseXOR(F.col("fp"))).cast("long").alias("far")).distinct()
    within = forest(nodes.select("node", "fp0"), radius, direct=True)
    out = settle(near.unionByName(within).groupBy("u", "v").agg(F.min("far").alias("far")))
    free(within)
    return out


def _similar_roots(docs: DataFrame, nodes: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """node and root of every node that a link of the similarity reaches (roots left out)."""
    pairs = proposed(nodes, radius)
    groups = components(pairs).select("node", F.col("root").alias("grp"))
    groups = groups.unionByName(groups.select(F.col("grp").alias("node"), "grp").distinct())
    members = settle(groups.join(nodes, "node").select("node", "grp", F.col("first.key").alias("key")))
    bags = _bags_of(docs, members, shingle)
    sizes = bags.groupBy("grp").agg(F.sum(F.octet_length("bag")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tasks = max(total["bytes"] // BLOCK, total["n"] // MOST) + 1
    large = settle(sizes.withColumn("blocks", _blocks()).filter("blocks > 1").select("grp", "blocks"))
    large = F.broadcast(large) if large.count() <= SMALL else large  # two numbers for each group beyond a block

    def resolve(table: pa.Table) -> pa.Table:
        grp, node = (table.column(c).to_numpy() for c in ("grp", "node"))
        order = np.argsort(grp, kind="stable")
        u, v = [], []
        for own in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            label = resolved(Bags(table.column("bag").take(pa.array(own)).to_pylist()), similarity) if len(own) > 1 else np.zeros(1, np.int64)
            far = np.flatnonzero(label != np.arange(len(own)))
            u.append(node[own[far]])
            v.append(node[own[label[far]]])
        return pa.table([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (u, v)], ["u", "v"])

    own = bags.join(large, "grp", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("node"), "blocks")).otherwise(-1))
    task = F.when(F.col("block") < 0, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.col("grp"))
    links = settle(own.withColumn("task", task).select("task", "block", "grp", "node", "bag").groupBy("task", "block").applyInArrow(resolve, "u long, v long"))
    if not large.isEmpty():
        links = _across(bags.join(large, "grp"), pairs, links, similarity)
    roots = components(links)
    free(bags, members, pairs)
    return roots


def _across(bags: DataFrame, pairs: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """links with those between the blocks of large groups; bags (grp, node, bag, blocks) are of these."""
    nodes = settle(bags.select("grp", "node", "blocks"))
    mine = settle(_rooted(nodes.select("node"), links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "part"))
    ends = [mine.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part")) for c in "uv"]
    apart = pairs.join(ends[0], "u").join(ends[1], "v").filter("u_part <> v_part")
    closest = apart.groupBy(F.least("u_part", "v_part").alias("a"), F.greatest("u_part", "v_part").alias("b")).agg(F.min(F.struct("far", "u", "v")).alias("p"))
    links = settle(links.unionByName(_verified(settle(closest.select("p.u", "p.v")), bags, similarity)))
    parts = settle(_rooted(nodes, components(links), "node", "part"))
    most = parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.min(F.struct((-F.col("n")).alias("n"), "part")).alias("m")).select("grp", F.col("m.part").alias("largest"))
    others = settle(parts.join(most, "grp").filter("part <> largest").select("node", "part"))
    if others.isEmpty():
        return links
    outside = bags.join(others, "node")
    rows = settle(outside.groupBy("grp").agg(F.sum(F.octet_length("bag")).alias("bytes"), F.count(F.lit(1)).alias("n")).select("grp", _blocks().alias("rows")))
    # Each block of all nodes meets each block of those outside the largest part.
    every = bags.join(parts.select("node", "part"), "node").join(rows, "grp").select("grp", F.pmod(F.xxhash64("node"), "blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("j"), F.lit(False).alias("outside"), "node", "part", "bag")
    few = outside.join(rows, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), "rows").alias("j"), F.lit(True).alias("outside"), "node", "part", "bag")

    def compare(table: pa.Table) -> pa.Table:
        node, part, out = (table.column(c).to_numpy() for c in ("node", "part", "outside"))
        own, u, v = Bags(table.column("bag").to_pylist()), [], []
        inside = np.flatnonzero(~out)
        for k in np.flatnonzero(out):
            far = inside[part[inside] != part[k]]
            hit = far[own.alike(k, far, similarity)]
            hit = hit[np.unique(part[hit], return_index=True)[1]]
            u += [node[k]] * len(hit)
            v += node[hit].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in (u, v)], ["u", "v"])

    found = every.unionByName(few).groupBy("grp", "i", "j").applyInArrow(compare, "u long, v long")
    return settle(links.unionByName(found))


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, key (row_key), fp0 and first, the row of its group that comes first: doc_id and key.

    Rows whose bags of shingles have the Jaccard similarity are linked if they are proposed (see the module), and groups are what links reach; equal bags always are
    (two of no shingle too). A null doc_id comes after all others. A text of any length is cut whole, in its row.
    """
    prints = settle(_bag_prints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    nodes = settle(prints.groupBy("node", "fp0").agg(first, F.first("names").alias("names")))  # equal for equal bags
    roots = settle(_similar_roots(docs, nodes, shingle, radius, similarity))
    labelled = nodes.drop("names").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = settle(labelled.groupBy("root").agg(F.min("first").alias("first")))
    labels = settle(labelled.select("root", "node").join(least, "root").select("node", "first"))
    free(nodes, roots, least)
    return prints.join(labels, "node").select("doc_id", "key", "fp0", "first")


def near_dups(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, lanes: int = 1, similarity: float | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp0.., component_id (the smallest doc_id that links reach, its own included).

    With similarity, a link is a pair of that Jaccard similarity of shingle bags or more that is proposed (see similar); there is one lane then.
    Texts without a word have fingerprint 0 and are linked like any other; null texts are such. A null doc_id
    counts as larger than any other. Rows that repeat are rows of their own. A text of any length is cut whole, in its row. Other columns are not read.
    An empty table gives an empty result.
    """
    if similarity is not None:
        return similar(docs, shingle, similarity, radius).withColumn("component_id", F.col("first.doc_id")).drop("key", "first")
    prints = settle(fingerprints(docs, shingle, lanes))
    names = [f"fp{k}" for k in range(lanes)]
    node = F.col("fp0") if lanes == 1 else F.xxhash64(*names)
    nodes = settle(prints.groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("node", node))
    links = forest(nodes.select("node", *names), radius)
    roots = components(links)
    labelled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = settle(labelled.groupBy("root").agg(F.min("first").alias("component_id")))
    labels = settle(labelled.select("root", *names).join(first, "root").select(*names, "component_id"))
    free(nodes, links, roots, first)
    return prints.join(labels, names).select("doc_id", *names, "component_id")


def query(docs: DataFrame) -> DataFrame:
    return near_dups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
