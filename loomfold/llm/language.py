"""Language identification by n-gram filters with a language bitmask.

Each language has a Bloom filter of the n-grams that are typical of it. The filters have the same length and hash functions and
are stored bit-sliced: a bit of each language per position, in as many 64-bit words as the languages need. The AND of the words at an n-gram's positions is
the mask of all languages that contain it, so one probe answers for every language. A text's masks are counted per
language; counts are corrected for each filter's false positives, and the language with the most n-grams is told.

N-grams are runs of N characters of the lower-cased text, in which every run of non-letters is one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, text_batches

#: The filters are fitted on at most this many documents of each language, of smallest hash.
SAMPLE = 4000
#: An n-gram is in a language's filter if this share of its documents has it; at most KEPT, those of most documents.
SHARE, KEPT = 0.03, 60_000
N, PROBES, BITS_PER_GRAM = 4, 4, 12
CHUNK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For each code unit below 2**16: itself lower-cased if it is a letter, else a space. Astral letters are handled as one class."""
    return np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)


_TABLE = None


def grams(text: str | None) -> np.ndarray:
    """Hashes of the n-grams of a text; none if it has no letter."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    small = code < 1 << 16
    code = np.where(small, _TABLE[np.where(small, code, 32)], code if small.all() else np.array([c if c < 1 << 16 or chr(c).isalpha() else 32 for c in code.tolist()], np.uint32)).astype(np.uint64)
    space = code == 32
    code = code[~(space & np.concatenate([[False], space[:-1]]))]
    if not (code != 32).any():
        return np.empty(0, np.uint64)
    code = np.concatenate([[32] if code[0] != 32 else [], code, [32] if code[-1] != 32 else [], [32] * max(0, N - 2 - len(code))]).astype(np.uint64)
    h = np.zeros(len(code) - N + 1, np.uint64)
    for k in range(N):
        h = (h ^ code[k : k + len(h)]) * _PRIME
        h ^= h >> np.uint64(29)
    return h


def _positions(h: np.ndarray, length: int) -> Iterator[np.ndarray]:
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for k in range(PROBES):
        yield ((a + np.uint64(k) * b) % np.uint64(length)).astype(np.int64)


class Model:
    """languages, the bit-sliced filters and each language's rate of false positives."""

    def __init__(self, languages: list[str], typical: list[np.ndarray]):
        self.languages = languages
        self.length = max(64, BITS_PER_GRAM * max(map(len, typical), default=0))
        # Language l has bit l % 64 of word l // 64.
        self.words = np.zeros((self.length, max(1, -(-len(languages) // 64))), np.uint64)
        for k, own in enumerate(typical):
            for at in _positions(own, self.length):
                self.words[at, k // 64] |= np.uint64(1 << k % 64)
        fill = [((self.words[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
        self.false = np.array(fill) ** PROBES

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and the share of n-grams that the language's filter knows, net of false positives."""
        count, n = np.zeros(len(self.languages)), 0
        h = grams(text)
        for part in np.array_split(h, len(h) * self.words.shape[1] // CHUNK + 1):
            mask = np.full((len(part), self.words.shape[1]), ~np.uint64(0))
            for at in _positions(part, self.length):
                mask &= self.words[at]
            for k in range(len(self.languages)):
                count[k] += ((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum()
            n += len(part)
        if not n or not self.languages:
            return "und", 0.0, 0.0
        net = np.maximum(0, (count - n * self.false) / (1 - self.false))
        k = int(net.argmax())
        return self.languages[k], float(net[k] / net.sum()) if net[k] > 0 else 0.0, float(min(1, net[k] / n))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, share: float = SHARE, kept: int = KEPT) -> Model:
    """Fits on the rows of docs (doc_id, text, lang) that have a language and are not held out; at most sample of each language.

    Every language is learned, however many. A table without such rows gives an empty model.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = known.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return Model([], [])
    # Documents whose hash is small: the share that leaves about sample of each language, none of it sorted.
    limits = spark.createDataFrame([(r["lang"], int(min(1.0, sample / r["count"]) * (2**63 - 1)) if r["count"] > sample else 2**63 - 1) for r in sizes], "lang string, below long")
    chosen = known.join(F.broadcast(limits), "lang").filter(F.col("h").bitwiseAND(F.lit(2**63 - 1)) <= F.col("below")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}
        seen: dict[str, int] = {}

        def fold(lang: str) -> None:
            h0, n0 = sums.get(lang, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            h, n = np.unique(np.concatenate(fresh.pop(lang)), return_counts=True)
            h, back = np.unique(np.concatenate([h0, h]), return_inverse=True)
            sums[lang] = h, np.bincount(back, np.concatenate([n0, n])).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = fresh.setdefault(lang, [])
                own.append(np.unique(grams(text)))
                seen[lang] = seen.get(lang, 0) + 1
                if len(own) >= 256:
                    fold(lang)
        for lang in list(fresh):
            fold(lang)
        for lang, (h, n) in sums.items():
            # The row without an n-gram holds the number of documents.
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(h) + 1), pa.string()), "gram": pa.array([*h.view(np.int64).tolist(), None], pa.int64()), "n": pa.array([*n.tolist(), seen[lang]], pa.int64())})

    counts = settle(text_batches(chosen).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    seen = {r["lang"]: r["n"] for r in counts.filter("gram is null").collect()}
    languages = sorted(seen)
    typical = []
    for lang in languages:
        own = counts.filter((F.col("lang") == lang) & F.col("gram").isNotNull() & (F.col("n") >= share * seen[lang])).orderBy(F.desc("n"), "gram").limit(kept)
        typical.append(own.select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64))
    return Model(languages, typical)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and known appended (columns of these names are replaced).

    lang_pred is a language of the model, or ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned. score is the language's part of all languages' corrected counts; known is the share of the text's n-grams that it knows.
    Ties go to the language first in code point order. Repeated rows stay. A text of any length counts with all its
    n-grams, some at a time. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "score", "known"]
    own = docs.drop(*names)
    schema = T.StructType([*own.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return text_batches(own).mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "known")
