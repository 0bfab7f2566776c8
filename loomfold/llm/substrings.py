"""Substring deduplication by a depth-limited radix sort of suffixes.

Only the first LENGTH bytes of a suffix count. The sort goes from the most significant digit down and drops groups of one
after each pass; what is left after the last pass are the repeated windows.

The first digit has to spread every suffix over the cluster, so it is chosen to be the same for neighbours: the
window's minimiser, its GRAM bytes of smallest hash. Consecutive windows of equal minimiser form a run, one row instead of
a row per byte, and equal windows always have equal minimisers. GRAM is long enough that in ordinary text a minimiser seen twice is
mostly part of a repeated window; a shorter one repeats by chance ever more often as the corpus grows. Passes:

1. Runs are counted by the minimiser's hash, and those of minimisers seen once are dropped.
2. Equal runs (128 bits: of the minimiser and of all bytes) become one kind with a weight, its number of occurrences. A minimiser of one
   kind is a group that no further digit can split: all its windows are repeated. Only where kinds differ are bytes fetched, of
   one occurrence of each kind, from the documents that hold one.
3. The windows of such kinds are sorted by five digits of 40 bytes; groups of weight one leave after each pass. A task sorts
   many minimisers; the windows of a minimiser with more than HOT kinds are spread over the cluster, one shuffle a digit.

A fixed-size bitmap of the minimisers found repeated in pass 1 keeps most other runs from being written in pass 2. It lets false ones through,
never loses one, and pass 2 counts exactly; with more repeated minimisers than bits all runs are written, some 20 bytes for each 70 of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, free, in_bitmap, possible, settle, text_batches

LENGTH, GRAM, DIGIT = 200, 64, 40
#: Bytes looked at at once (as a power of two); kinds of a minimiser that are compared in one task; kinds in a task.
CHUNK_BITS, HOT, TASK = 20, 10_000, 10_000
DOC = ["doc_id", "text_hash"]
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    out = np.full(1 << CHUNK_BITS, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_CACHE: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _CACHE:
        _CACHE["t"] = _mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03)), _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    return _CACHE["t"]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _prefix(x: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows: (prefix[b] - prefix[a]) / base**a."""
    byte, power, _ = _tables()
    return np.concatenate([[_U(0)], np.cumsum(byte[x] * power[: len(x)], dtype=_U)])


def _stretch(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix((prefix[b] - prefix[a]) * _tables()[2][a])


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, minimiser, content hash) of the runs of a text, stretch by stretch."""
    size, width, low = 1 << CHUNK_BITS, length - gram + 1, _U((1 << CHUNK_BITS) - 1)
    for base in range(0, len(text) - length + 1, size - length + 1):
        x = np.frombuffer(text, np.uint8, min(size, len(text) - base), base)
        prefix, n = _prefix(x), len(x) - gram + 1
        at = np.arange(n)
        grams = _stretch(prefix, at, at + gram)
        # Minimum over each window, the leftmost of equal ones: within blocks from either side.
        key = np.full(-(-n // width) * width, ~_U(0))
        key[:n] = (grams & ~low) | at.astype(_U)
        blocks = key.reshape(-1, width)
        ahead, back = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        where = (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        windows = np.diff(np.append(start, len(where)))
        yield start + base, windows, grams[where[start]], _stretch(prefix, start, start + windows + length - 1)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _repeated_minimisers(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r[2] for t in _texts(batch) for r in runs(t, length, gram)]
            if found:
                at, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n)], ["minimiser", "n"])

    rows = text_batches(docs.select("text")).mapInArrow(run, "minimiser long, n long")
    return settle(rows.groupBy("minimiser").agg(F.sum("n").alias("n")).filter("n > 1").select("minimiser"))


def _occurrences(docs: DataFrame, repeated: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of minimisers that the bitmap of repeated ones lets through: a document's key, start, windows, minimiser, content."""
    words = docs.sparkSession.sparkContext.broadcast(bitmap(repeated, "minimiser"))
    names = ["start", "windows", "minimiser", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], []
            for k, t in enumerate(_texts(batch)):
                for start, windows, a, c in runs(t, length, gram):
                    kept = in_bitmap(words.value, a)
                    rows.append(np.full(kept.sum(), k))
                    columns.append((start[kept], windows[kept], a[kept].view(np.int64), c[kept].view(np.int64)))
            if columns:
                keys = batch.select(DOC).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(np.concatenate(x)) for x in zip(*columns, strict=True))], [*DOC, *names])

    schema = T.StructType([docs.schema["doc_id"], docs.schema["text_hash"], *[T.StructField(n, T.LongType()) for n in names]])
    return settle(text_batches(docs).mapInArrow(run, schema))


def _kinds(found: DataFrame) -> DataFrame:
    """(minimiser, content, weight, windows, variants, rep) of runs that are equal, where the minimiser is repeated; rep is one occurrence."""
    rep = F.min(F.struct(*DOC, "start")).alias("rep")
    kinds = settle(found.groupBy("minimiser", "content").agg(F.count(F.lit(1)).alias("weight"), F.max("windows").alias("windows"), rep))
    totals = kinds.groupBy("minimiser").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("variants")).filter("total > 1")
    out = settle(kinds.join(settle(totals.select("minimiser", "variants")), "minimiser"))
    free(kinds)
    return out


def _with_bytes(docs: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """mixed (minimiser, content, weight, variants, windows, rep) with the bytes of each kind, cut from the document of its rep."""
    kept = ["minimiser", "content", "weight", "variants"]
    wanted = mixed.groupBy("rep.doc_id", "rep.text_hash").agg(F.collect_list(F.struct(*kept, "windows", F.col("rep.start").alias("start"))).alias("runs"))
    wanted = settle(wanted.select(F.col("doc_id").alias("doc_id_"), F.col("text_hash").alias("text_hash_"), "runs"))
    # Most documents hold no kind's bytes; the others' are brought to their runs, a row that repeats once.
    own = possible(text_batches(docs), "text_hash", wanted, "text_hash_").dropDuplicates(DOC)
    joined = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_"))).select("text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("runs")
            rows = own.flatten()
            owner = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
            texts = _texts(batch)
            start, windows = (rows.field(n).to_numpy() for n in ("start", "windows"))
            cut = [texts[k][a : a + n + length - 1] for k, a, n in zip(owner.tolist(), start.tolist(), windows.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.field(n) for n in kept), pa.array(cut, pa.binary())], [*kept, "bytes"])

    out = settle(joined.mapInArrow(run, "minimiser long, content long, weight long, variants long, bytes binary"))
    free(wanted)
    return out


def _digits(text: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of every window of every run: the run, the window's place in it, and its digits, most significant first."""
    run, place, digits = [], [], []
    steps = [*range(0, length, DIGIT), length]
    group, size = [], 0

    def flush() -> None:
        buffer = b"".join(text[k] for k in group)
        prefix, at = _prefix(np.frombuffer(buffer, np.uint8)), 0
        starts = []
        for k in group:
            n = len(text[k]) - length + 1
            starts.append(np.arange(at, at + n))
            run.append(np.full(n, k))
            place.append(np.arange(n))
            at += len(text[k])
        s = np.concatenate(starts)
        digits.append([_stretch(prefix, s + a, s + b) for a, b in zip(steps, steps[1:], strict=False)])

    for k, t in enumerate(text):
        if group and size + len(t) > 1 << CHUNK_BITS:
            flush()
            group, size = [], 0
        group.append(k)
        size += len(t)
    if group:
        flush()
    return np.concatenate(run), np.concatenate(place), [np.concatenate(d) for d in zip(*digits, strict=True)]


def radix_groups(first: np.ndarray, digits: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Which windows are repeated: sorted by first, then digit by digit, groups of weight one leaving after each pass."""
    left, group = np.arange(len(first)), first
    for digit in [None, *digits]:
        if not len(left):
            break
        own = group if digit is None else digit[left]
        order = np.lexsort((own, group))
        g, d = group[order], own[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        name, starts = np.cumsum(new), np.flatnonzero(new)
        again = np.add.reduceat(weight[left[order]], starts) > 1
        kept = again[name - 1]
        left, group = left[order][kept], name[kept]
    out = np.zeros(len(first), bool)
    out[left] = True
    return out


def _ranges(run: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first place, end place) of stretches of consecutive places; sorted by run and place before."""
    order = np.lexsort((place, run))
    run, place = run[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)])) if len(run) else np.empty(0, int)
    last = np.append(new[1:], len(run)) - 1 if len(run) else new
    return run[new], place[new], place[last] + 1


SPAN = "minimiser long, content long, first long, end long"


def _hot_ranges(kinds: DataFrame, length: int) -> DataFrame:
    """_repeated_ranges for minimisers of any number of kinds: a window is a row, and every digit a pass over the cluster."""
    digits = [f"d{k}" for k in range(-(-length // DIGIT))]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("bytes").to_pylist()
            if text:
                run, place, found = _digits(text, length)
                keys = batch.select(["minimiser", "content", "weight"]).take(pa.array(run))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(place), *(pa.array(d.view(np.int64)) for d in found)], ["minimiser", "content", "weight", "place", *digits])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("minimiser"), batch.column("content"), pa.array(place), pa.array(place + 1)], ["minimiser", "content", "first", "end"])

    own = kinds.dropDuplicates(["minimiser", "content"])
    left = settle(own.mapInArrow(explode, "minimiser long, content long, weight long, place long, " + ", ".join(f"{d} long" for d in digits)))
    for k in range(len(digits)):
        key = ["minimiser", *digits[: k + 1]]
        again = settle(left.groupBy(*key).agg(F.sum("weight").alias("n")).filter("n > 1").select(*key))
        before, left = left, settle(left.join(again, key, "left_semi"))
        free(before, again)
    return left.mapInArrow(gather, SPAN)


def _repeated_ranges(kinds: DataFrame, length: int) -> DataFrame:
    """kinds (minimiser, content, weight, variants, bytes) of minimisers of several kinds: (minimiser, content, first, end) of repeated windows."""
    tasks = max(1, -(-kinds.count() // TASK))

    def compare(group: pa.Table) -> pa.Table:
        first = group.column("minimiser").to_numpy(), group.column("content").to_numpy()
        order = np.lexsort(first[::-1])
        m, c = (x[order] for x in first)
        group = group.take(pa.array(order[np.concatenate([[True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])])]))  # a kind may come twice from tasks run again
        run, place, digits = _digits(group.column("bytes").to_pylist(), length)
        first = np.unique(group.column("minimiser").to_numpy(), return_inverse=True)[1]
        run, a, b = _ranges(*(x[radix_groups(first[run], digits, group.column("weight").to_numpy()[run])] for x in (run, place)))
        return pa.table([*group.select(["minimiser", "content"]).take(pa.array(run)).columns, pa.array(a), pa.array(b)], ["minimiser", "content", "first", "end"])

    few = kinds.filter(F.col("variants") <= HOT).withColumn("task", F.pmod(F.xxhash64("minimiser"), F.lit(tasks)))
    found, many = few.groupBy("task").applyInArrow(compare, SPAN), kinds.filter(F.col("variants") > HOT)
    return found if many.isEmpty() else found.unionByName(_hot_ranges(many, length))


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, spans): the byte ranges of keyed docs that repeated windows cover; ranges may overlap."""
    repeated = _repeated_minimisers(docs, length, gram)
    found = _occurrences(docs, repeated, length, gram)
    kinds = _kinds(found)
    pieces = _with_bytes(docs, kinds.filter("variants > 1"), length)
    whole = kinds.filter("variants = 1").select("minimiser", "content", F.lit(0).cast("long").alias("first"), F.col("windows").alias("end"))
    ranges = settle(whole.unionByName(_repeated_ranges(pieces, length)))
    free(repeated, kinds, pieces)
    spans = found.select(*DOC, "start", "minimiser", "content").join(ranges, ["minimiser", "content"])
    span = F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("end") + length - 1).alias("b"))
    out = settle(spans.groupBy(*DOC).agg(F.collect_set(span).alias("spans")))
    free(found, ranges)
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, kept (the bytes left), n_bytes, n_removed, n_spans, kept_sha256.

    A null text is an empty one; texts shorter than length keep all. Rows that repeat are documents that hold each other's text. A null
    doc_id is an id like any other. Spans are maximal removed runs. A text of any length is cut into runs of its own, in its row. Other columns are not read; an empty table gives an empty result.
    """
    own = _keyed(docs)
    spans = covered(own, length, gram).select(F.col("doc_id").alias("doc_id_"), F.col("text_hash").alias("text_hash_"), "spans")
    joined = own.join(spans, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(_texts(batch), batch.column("spans").to_pylist(), strict=True):
                gone = _union([(s["a"], s["b"]) for s in spans or ()])
                edges = [0, *(x for s in gone for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((kept, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("kept", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    return text_batches(joined).mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
