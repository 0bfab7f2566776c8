"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of adjacent words, told apart by 64-bit hashes. With an absolute
discount D, P(w | v) = max(n(vw) - D, 0) / n(v) + l(v) P(w), where l(v) is the part of n(v) that the discount frees. P(w) is of continuation
counts: c(w) distinct words precede w in the class, of c in all, and P(w) = max(c(w) - D, 0) / c + L S(w). The last level S is shared by
both classes: counts of words in all documents of the corpus, labelled or not, with one added for each distinct word.

D is above 1, so that a pair or a preceding word seen once is left to the level below. What no class has more than once has the ratio of the
level below, whatever its counts, so the model holds the rest only: as much as the labelled texts make, and the corpus adds none.

A text's evidence is the length-normalised log-likelihood ratio of the whole text, the largest and the three largest ratios of a word P(w), the
largest of a pair P(w | v), and the logarithm of the length, as the largest of more ratios is larger by chance. A logistic curve, fitted on
labelled texts that the counts have not seen, makes them a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, settle, table, text_batches
from .language import held_out

#: Bounds of the labelled documents learned from (of smallest hash); words that a task holds before it emits their counts.
LABELLED, CALIBRATED, HELD = 100_000, 20_000, 1 << 20
DISCOUNT, TOP, THRESHOLD = 1.5, 3, 0.3
EVIDENCE = 5
NAMES = [f"evidence{k}" for k in range(EVIDENCE)]
_KEPT = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: What stands before a text's first word.
BEGIN = 0


def words(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, in order; words are runs of letters, digits and non-ASCII, A-Z lower-cased."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in (text or b"").lower().translate(_KEPT).split()], np.uint64).view(np.int64)


def before(h: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The word before each of one text, or of several that begin at starts."""
    v = np.concatenate([np.array([BEGIN], np.int64), h[:-1]])[: len(h)]
    if starts is not None:
        v[starts] = BEGIN
    return v


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    z = (first.view(np.uint64) * _PRIME) ^ second.view(np.uint64)
    z = (z ^ (z >> np.uint64(31))) * _PRIME
    return (z ^ (z >> np.uint64(29))).view(np.int64)


class Known:
    """Values of sorted hashes, a row for ordinary and one for toxic; default for any other hash."""

    def __init__(self, known: np.ndarray, values: np.ndarray, default: np.ndarray):
        order = np.argsort(known)
        self.known, self.values = known[order], np.empty((len(values), len(known) + 1), np.float32)
        self.values[:, :-1], self.values[:, -1] = values[:, order], default

    def __call__(self, h: np.ndarray) -> np.ndarray:
        h, back = np.unique(h, return_inverse=True)  # sorted, the search stays in the cache
        at = np.searchsorted(self.known, h)
        missing = len(self.known)
        if missing:
            at = np.where(self.known[np.minimum(at, missing - 1)] == h, at, missing)
        return self.values[:, at[back]]


class Model:
    """P(w) of words, l(v) of the words before, max(n(vw) - D, 0) / n(v) of pairs; None where a class has no text."""

    def __init__(self, levels: tuple[Known, Known, Known] | None):
        self.levels, self.weights, self.sent = levels, np.zeros(EVIDENCE + 1), None

    def shared(self, spark: SparkSession) -> tuple[Broadcast, np.ndarray]:
        """The levels as one broadcast, sent once for the calibration and all scores, and the weights."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(Model(self.levels))
        return self.sent, self.weights

    def ratios(self, h: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log P(. | toxic) - log P(. | ordinary) of each word alone and after the word before it."""
        if self.levels is None:
            return np.zeros(len(h)), np.zeros(len(h))
        word, freed, pair = self.levels
        v = before(h, starts)
        low = word(h).astype(float)
        high = pair(pair_hash(v, h)) + freed(v) * low
        return np.log(low[1] / low[0]), np.log(high[1] / high[0])

    def evidence(self, hashes: list[np.ndarray]) -> np.ndarray:
        """A row for each text, given as the hashes of its words; zeros without a word."""
        sizes = np.array([len(h) for h in hashes], int)
        out, full = np.zeros((len(hashes), EVIDENCE)), np.flatnonzero(sizes)
        if len(full):
            h, starts = np.concatenate([hashes[k] for k in full]), np.cumsum(sizes[full]) - sizes[full]
            low, high = self.ratios(h, starts)
            out[full, 0] = np.add.reduceat(high, starts) / sizes[full]
            out[full, 3] = np.maximum.reduceat(high, starts)
            out[full, 4] = np.log(sizes[full])
            for k, a, n in zip(full.tolist(), starts.tolist(), sizes[full].tolist(), strict=True):
                top = np.sort(low[a : a + n] if n <= TOP else np.partition(low[a : a + n], n - TOP)[-TOP:])
                out[k, 1], out[k, 2] = top[-1], top.sum() / TOP
        return out

    def calibrate(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Fits the logistic curve by Newton's method, slightly drawn to zero; without both classes it stays at their share."""
        x = np.c_[np.ones(len(evidence)), evidence]
        w = np.zeros(x.shape[1])
        share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
        if len(set(toxic.tolist())) < 2:
            self.weights = np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6)), *[0.0] * EVIDENCE])
            return
        penalty = np.diag([1e-6, *[0.1] * (len(w) - 1)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return curve(evidence, self.weights)


def curve(evidence: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + evidence @ weights[1:], -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most most rows (doc_id, toxic, calibrates): labelled documents that are not held out, one of each distinct text."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    own = own.withColumn("calibrates", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3)
    own = settle(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    with_text = docs.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(own), "doc_id")  # at most most rows
    return settle(with_text.groupBy("h").agg(F.min(F.struct("doc_id", "toxic", "calibrates")).alias("r")).select("r.*").dropDuplicates(["doc_id"]))


def _pairs(texts: DataFrame) -> DataFrame:
    """(v, w, n0, n1): how often the ordinary and the toxic of texts (text, toxic) have w after v."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[tuple[np.ndarray, int]] = []

        def emitted() -> Iterator[pa.RecordBatch]:
            own = [[h for h, t in fresh if t == toxic] for toxic in (0, 1)]
            w = np.concatenate([np.empty(0, np.int64), *own[0], *own[1]])
            v = np.concatenate([np.empty(0, np.int64), *map(before, own[0]), *map(before, own[1])])
            _, first, back = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
            cut = sum(map(len, own[0]))
            n = [np.bincount(x, minlength=len(first)) for x in (back[:cut], back[cut:])]
            fresh.clear()
            for part in np.array_split(np.arange(len(first)), len(first) // 65_536 + 1):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[first[part]], w[first[part]], n[0][part], n[1][part])], ["v", "w", "n0", "n1"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").cast(pa.binary()), batch.column("toxic").to_pylist(), strict=True):
                fresh.append((words(text.as_py()), int(bool(toxic))))
            if sum(len(h) for h, _ in fresh) > HELD:
                yield from emitted()
        yield from emitted()

    return settle(text_batches(texts).mapInArrow(count, "v long, w long, n0 long, n1 long").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _word_counts(texts: DataFrame) -> DataFrame:
    """(w, n) of every word of every row of texts (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[np.ndarray] = []

        def emitted() -> Iterator[pa.RecordBatch]:
            w, n = np.unique(np.concatenate([np.empty(0, np.int64), *fresh]), return_counts=True)
            fresh.clear()
            for part in np.array_split(np.arange(len(w)), len(w) // 65_536 + 1):
                yield pa.RecordBatch.from_arrays([pa.array(w[part]), pa.array(n[part])], ["w", "n"])

        for batch in batches:
            fresh += [words(text.as_py()) for text in batch.column("text").cast(pa.binary())]
            if sum(map(len, fresh)) > HELD:
                yield from emitted()
        yield from emitted()

    return settle(text_batches(texts).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))


def _levels(pairs: DataFrame, corpus: DataFrame) -> tuple[Known, Known, Known] | None:
    """The three levels from pairs (v, w, n0, n1) and the shared counts (w, n) of the whole corpus."""
    both, off = ("0", "1"), lambda c: F.least(F.col(c), F.lit(DISCOUNT))
    again = F.max(F.greatest("n0", "n1")).alias("most")
    follows = settle(pairs.groupBy("w").agg(*[F.sum((F.col(f"n{k}") > 0).cast("long")).alias(f"c{k}") for k in both], again))
    totals = follows.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in both], *[F.sum(off(f"c{k}")).alias(f"f{k}") for k in both]).first()
    c, f = (np.array([float(totals[f"{x}{k}"] or 0) for k in both]) for x in "cf")
    if not c.all():
        return None
    sums = corpus.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    share = 1.0 / (sums["n"] + sums["v"])
    shared = (F.col("n") + F.lit(1)) * F.lit(share)
    word = [((F.greatest(F.col(f"c{k}") - DISCOUNT, F.lit(0.0)) + F.lit(float(f[int(k)])) * shared) / F.lit(float(c[int(k)]))).alias(f"p{k}") for k in both]
    known = follows.filter(f"greatest(c0, c1) > {DISCOUNT} or most > {DISCOUNT}").join(corpus, "w").select(F.col("w").alias("h"), *word)
    after = settle(pairs.groupBy("v").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in both], *[F.sum(off(f"n{k}")).alias(f"f{k}") for k in both], again).filter(f"most > {DISCOUNT}"))
    context = after.select(F.col("v").alias("h"), *[F.when(F.col(f"n{k}") > 0, F.col(f"f{k}") / F.col(f"n{k}")).otherwise(1.0).alias(f"p{k}") for k in both])
    taken = pairs.filter(f"greatest(n0, n1) > {DISCOUNT}").join(after.select("v", F.col("n0").alias("all0"), F.col("n1").alias("all1")), "v")
    found = taken.select("v", "w", *[F.coalesce(F.try_divide(F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)), F.col(f"all{k}")), F.lit(0.0)).cast("float").alias(f"p{k}") for k in both])
    # Of a word that is not known only the ratio counts, not how common it is.
    out = _known(known, f / c * share), _known(context, np.ones(2)), _known(found.mapInArrow(_hashed, "h long, p0 float, p1 float"), np.zeros(2))
    free(follows, after)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = pair_hash(batch.column("v").to_numpy(), batch.column("w").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("p0"), batch.column("p1")], ["h", "p0", "p1"])


def _known(level: DataFrame, default: np.ndarray) -> Known:
    """A level from rows (h, p0, p1), which come to the driver in 16 bytes each."""
    rows = level.select("h", F.col("p0").cast("float"), F.col("p1").cast("float")).toArrow()
    return Known(rows.column("h").to_numpy(), np.array([rows.column("p0").to_numpy(), rows.column("p1").to_numpy()]), default)


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Fits on docs (doc_id, text) and labels (doc_id, toxic 0 or 1). Of contrary labels of a document, toxic counts."""
    chosen = _labelled(docs, labels, most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pairs = _pairs(rows.join(F.broadcast(chosen.filter("not calibrates")), "doc_id").select("text", "toxic"))  # at most most rows
    corpus = _word_counts(rows.select("text"))
    model = Model(_levels(pairs, corpus))
    free(pairs, corpus)
    judged = docs.join(F.broadcast(chosen.filter("calibrates").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATED)), "doc_id").select("doc_id", "text", "toxic")
    seen = _with_evidence(judged, model).select("toxic", *NAMES).toPandas()
    model.calibrate(seen[NAMES].to_numpy(float).reshape(-1, EVIDENCE), seen["toxic"].to_numpy(float))
    return model


def _with_evidence(docs: DataFrame, model: Model) -> DataFrame:
    shared, weights = model.shared(docs.sparkSession)
    names = [*NAMES, "score"]
    kept = docs.drop("text", *names)
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [np.zeros((0, EVIDENCE))], []
            for text in batch.column("text").cast(pa.binary()):
                held.append(words(text.as_py()))
                if sum(map(len, held[-50:])) > HELD // 4 or len(held) == 200:
                    found.append(shared.value.evidence(held))
                    held = []
            found = np.concatenate([*found, shared.value.evidence(held)])
            more = [pa.array(x) for x in (*found.T, curve(found, weights))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *more], [*columns, *names])

    schema = T.StructType([*kept.schema, *[T.StructField(n, T.DoubleType()) for n in names]])
    return text_batches(docs).select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) without text, with score (0 to 1) and predicted (1 if score is at least THRESHOLD).

    Null and empty texts have no evidence and get the curve's value there. A text of any length is scored whole. Repeated rows stay; columns named like the
    results are replaced; an empty table gives an empty result.
    """
    return _with_evidence(docs, model).drop(*NAMES).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")
