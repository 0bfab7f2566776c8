"""Alignment of two tokenizers over a corpus by an event sweep.

A text is tokenized by A and by B. An event is the end of a token at a byte offset. The events of both sides are united,
repartitioned by document and sorted by offset within partitions; one pass over them is a state machine that holds the tokens of
the open group only. Where both sides have an event, the group closes, and the two tokens that end there are linked.

Events travel packed: a row is up to RUN consecutive tokens of a side with the offset of the first. A token's length follows from its id, so
a row holds 16-bit ids and its events' offsets are sums of lengths. Rows of the two sides meet in order of their first offset, so the
open tokens are those of a row or two, however long the text.

An id pair can only be linked if the bytes of one token end with those of the other. The vocabularies list these pairs (some hundred thousand, whatever
the corpus), so pairs are numbered, a table of their corpus-wide counts has a proven bound, and is broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table, text_batches

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens of a row of events.
RUN = 4096
#: Segments of up to SHORT characters are remembered, at most twice MEMORY of them in a worker; unknown ones are tokenized TOGETHER.
SHORT, MEMORY, TOGETHER = 48, 200_000, 256
#: Fixed value: how the byte-level tokenizer cuts words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Up to here the classes of characters have not changed with Unicode versions.
LATIN = "\u0250"
_CUT = re.compile(r"(?<=\S) (?!\Z)")
_WHITE = [chr(c) for c in range(1 << 16) if chr(c).isspace()]
_AFTER_ASCII, _AFTER_OTHER = [c + " " for c in _WHITE if c.isascii()], [c + " " for c in _WHITE if not c.isascii()]
EVENTS = "doc_id long, key long, n_bytes long, start long, side byte, sound boolean, ids binary"


def segments(text: str) -> list[str]:
    """The text cut at each space that follows anything but white space and does not end it; a segment stands for itself with a space in front.

    Neither tokenizer has a token across such a cut (Pieces checks it for B), so segments are tokenized one by one.
    """
    plain = not any(c in text for c in _AFTER_ASCII) and (text.isascii() or not any(c in text for c in _AFTER_OTHER))
    return text.split(" ") if plain and text[:1] != " " and text[-1:] != " " else _CUT.split(text)


class ByteLevel:
    """A: the ids of the space and the text by a byte-level vocabulary file; ``tokens`` are the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True  # their strings are ordinary text
        # The byte of each of the 256 characters: printable Latin-1 stands for itself, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        special = {t.content for t in self.coder.get_added_tokens_decoder().values()}
        self.tokens = [b""] * self.coder.get_vocab_size()
        for token, k in self.coder.get_vocab().items():
            self.tokens[k] = token.encode() if token in special else bytes(byte[c] for c in token)
        # The same merges as ranks, which is several times faster; for Latin text alone, as character classes depend on a library's Unicode version elsewhere.
        ranks = {bytes(byte[c] for c in token): k for token, k in self.coder.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.splits = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(" " + t) if t.isascii() or max(t) < LATIN else self.coder.encode(" " + t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """B: the ids of the text by a piece model, which puts a space in front itself; ``tokens`` are the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.coder.id_to_piece(k) for k in range(self.coder.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        #: No piece has a space after anything else, so none crosses the cuts of segments().
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1) if texts else []


class Coders:
    """Both tokenizers in a worker: ids of whole texts by their segments, of which it remembers the short ones met of late, in two generations."""

    def __init__(self, a_file: str, b_file: str):
        self.sides = ByteLevel(a_file), Pieces(b_file)
        for side in self.sides:
            if not all(side.tokens) or len(side.tokens) > 1 << 16:
                raise ValueError(f"{a_file} and {b_file} must have ids below 65,536 and no empty token")
        self.lengths = [np.array([len(t) for t in side.tokens], np.int64) for side in self.sides]
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _encode(self, side: int, groups: list[list[str]], found: dict[str, list]) -> None:
        """Appends a side's ids of each segment to found, None if their bytes are not those of the space and the segment."""
        texts, tokens = [" ".join(own) for own in groups], self.sides[side].tokens
        for own, text, ids in zip(groups, texts, self.sides[side].encode(texts), strict=True):
            if b"".join([tokens[k] for k in ids]) != (" " + text).encode("utf-8", "surrogatepass"):
                if len(own) > 1:
                    self._encode(side, [[s] for s in own], found)
                else:
                    found[own[0]].append(None)
                continue
            code = np.array(ids, np.uint16)
            cuts = np.cumsum([len(s.encode("utf-8", "surrogatepass")) + 1 for s in own])
            ends = (2 * np.searchsorted(np.cumsum(self.lengths[side][code]), cuts, "right")).tolist()
            packed = code.tobytes()
            for s, i, j in zip(own, [0, *ends], ends, strict=False):
                found[s].append(packed[i:j])

    def _learn(self, fresh: set[str]) -> dict[str, tuple]:
        out = {s: self.older[s] for s in fresh if s in self.older}
        fresh.difference_update(out)
        # Many segments at once as one text, except those that end in white space and would not be cut there.
        odd = [s for s in fresh if s[-1].isspace()]
        found: dict[str, list] = {s: [] for s in fresh}
        for chars in (True, False):
            own = [s for s in fresh.difference(odd) if s.isascii() == chars]
            for side in (0, 1):
                self._encode(side, [own[k : k + TOGETHER] for k in range(0, len(own), TOGETHER)], found)
        for side in (0, 1):
            self._encode(side, [[s] for s in odd], found)
        out |= {s: tuple(v) for s, v in found.items()}
        if len(self.known) + len(out) > MEMORY:
            self.older, self.known = self.known, {}
        self.known.update((s, v) for s, v in out.items() if len(s) <= SHORT)
        return out

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes | None, bytes | None]]:
        """16-bit ids of both sides of each text; None where the tokens' bytes are not those of the space and the text."""
        cut = [segments(t) if self.sides[1].splits else [t] for t in texts]
        values = [list(map(self.known.get, own)) for own in cut]
        learned = self._learn({s for own, v in zip(cut, values, strict=True) if None in v for s, x in zip(own, v, strict=True) if x is None})
        for own, v in zip(cut, values, strict=True):
            if None in v:
                v = [x or learned[s] for s, x in zip(own, v, strict=True)]
            a, b = zip(*v, strict=True)
            yield None if None in a else b"".join(a), None if None in b else b"".join(b)


_CODERS: dict[tuple, Coders] = {}


def _coders(*files: str) -> Coders:
    """One for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if files not in _CODERS:
        _CODERS[files] = Coders(*files)
    return _CODERS[files]


def events(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """The packed EVENTS of both sides of docs (doc_id, text); each row of docs has a row of start 0 of each side at least, also without tokens."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").isNull(), "text").alias("key"), "text")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(a_file, b_file)
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            found = coders([t for t in texts if t])
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), texts, strict=True):
                size = len((text or "").encode("utf-8", "surrogatepass"))
                for side, ids in enumerate(next(found) if text else (b"", b"")):
                    code = np.frombuffer(ids or b"", np.uint16)
                    ends = np.cumsum(coders.lengths[side][code])
                    for k in range(0, max(1, len(code)), RUN):
                        rows.append((doc_id, key, size, int(ends[k - 1]) if k else 0, side, ids is not None, code[k : k + RUN].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in EVENTS.split(", ")])

    return text_batches(own).mapInArrow(run, EVENTS)


class Vocabularies:
    """What the sweep needs of the two vocabularies: lengths, the pairs that can be linked, and decimal ids as text."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.n_b = len(b)
        self.length = np.array([len(t) for t in a], np.int64), np.array([len(t) for t in b], np.int64)
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for of, tokens in ((of_a, a), (of_b, b)):
            for k, t in enumerate(tokens):
                of.setdefault(t, []).append(k)
        codes = {i * self.n_b + j for j, t in enumerate(b) for k in range(len(t)) for i in of_a.get(t[k:], ())}
        codes |= {i * self.n_b + j for i, t in enumerate(a) for k in range(len(t)) for j in of_b.get(t[k:], ())}
        #: At most a pair for each byte of the tokens and id with equal bytes: the size of what is broadcast.
        self.pairs = np.array(sorted(codes), np.int64)
        self.b_of_pair = self.pairs % self.n_b


class _Sweep:
    """The state machine over one document's rows: tokens of the open group, counts so far, a running digest and the pairs linked."""

    def __init__(self, words: Vocabularies, spelled: np.ndarray):
        self.words, self.spelled = words, spelled
        none = np.empty(0, np.int64)
        self.open = [(none, none), (none, none)]  # ends and ids of each side since the last common event
        self.n, self.groups, self.pairs = [0, 0], 0, []
        self.text, self.held = hashlib.sha256(), b""
        self.last = [-1, -1]  # the first offset of the row read last
        self.copies, self.sound = 0, True

    def read(self, side: int, start: int, sound: bool, packed: bytes) -> None:
        self.copies += side == 0 and start == 0
        if start == self.last[side]:  # the same row of a repeated document
            return
        self.last[side] = start
        self.sound &= sound
        ids = np.frombuffer(packed, np.uint16).astype(np.int64)
        if not self.sound or not len(ids):
            return
        ends = start + np.cumsum(self.words.length[side][ids])
        self.n[side] += len(ids)
        was = self.open[side]
        self.open[side] = (np.concatenate([was[0], ends]), np.concatenate([was[1], ids])) if len(was[0]) else (ends, ids)
        if len(self.open[0][0]) and len(self.open[1][0]):
            self._close()

    def _close(self) -> None:
        """Closes the groups up to the last common event so far."""
        (ends_a, ids_a), (ends_b, ids_b) = self.open
        base = min(ends_a[0], ends_b[0])
        mark = np.zeros(max(ends_a[-1], ends_b[-1]) - base + 1, np.int8)
        mark[ends_a - base] = 1
        mark[ends_b - base] += 1
        mark >>= 1  # a common event
        at_a, at_b = mark[ends_a - base], mark[ends_b - base]
        last_a, last_b = np.flatnonzero(at_a), np.flatnonzero(at_b)
        if not len(last_a):
            return
        self.groups += len(last_a)
        self.pairs.append(ids_a[last_a] * self.words.n_b + ids_b[last_b])
        n_a, n_b = last_a[-1] + 1, last_b[-1] + 1
        self.text.update(self._spell(ids_a[:n_a], ids_b[:n_b], at_a[:n_a], at_b[:n_b], last_a, last_b))
        self.open = [(ends_a[n_a:], ids_a[n_a:]), (ends_b[n_b:], ids_b[n_b:])]

    def _spell(self, ids_a, ids_b, at_a, at_b, last_a, last_b) -> bytes:
        """The closed groups as text: ids of A, a bar, ids of B; a semicolon before each group but the document's first."""
        # A token of A follows the B tokens of the groups before, a token of B the A tokens of the groups up to its own.
        before = np.concatenate([[0], last_b + 1])[np.cumsum(at_a, dtype=np.int64) - at_a]
        upto = (last_a + 1)[np.cumsum(at_b, dtype=np.int64) - at_b]
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + before] = 4 * ids_a + at_a
        code[np.arange(len(ids_b)) + upto] = 4 * ids_b + 2 * at_b
        text = self.held + b"".join(self.spelled[code].tolist())
        self.held = text[-1:]  # the last semicolon waits for another group
        return text[:-1]

    def result(self) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, and the pairs as gaps between their sorted numbers, with how often each."""
        if not self.sound or not self.groups:
            return 0, 0, 0, 0, "", b"", b""
        code, times = np.unique(np.concatenate(self.pairs), return_counts=True)
        found = np.searchsorted(self.words.pairs, code)
        return *self.n, self.groups, self.groups, self.text.hexdigest(), np.diff(found, prepend=0).astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _spelled(n: int) -> np.ndarray:
    """Spellings of ids with what follows: at 4 * id a comma, at 4 * id + 1 a bar, at 4 * id + 2 a semicolon."""
    return np.array([f"{k}{c}".encode() for k in range(n) for c in ",|;,"], object)


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> tuple[DataFrame, Vocabularies]:
    """One ALIGNED row per row of docs (doc_id, text), stored, and the vocabularies that number its pairs.

    A text that is null or empty, or that one side does not give back byte for byte, has no tokens. A document is known by its id and a
    hash of its text, so null and repeated ids are documents of their own; rows that repeat both are swept once and told as often. A very long
    text is many rows of events, which the sweep reads one by one. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = Vocabularies(ByteLevel(a_file).tokens, Pieces(b_file).tokens)
    shared = spark.sparkContext.broadcast(words)
    document = ["doc_id", "key", "n_bytes"]
    ordered = events(docs, a_file, b_file).repartition(*document).sortWithinPartitions(*document, "start", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        spelled = _spelled(max(map(len, own.length)))
        now, sweep, rows = None, None, []

        def told() -> None:
            found = sweep.result()
            rows.extend([(now[0], *found)] * sweep.copies)

        def batch_of() -> pa.RecordBatch:
            kinds = (*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in ALIGNED.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for *which, start, side, sound, ids in zip(*(batch.column(f.split()[0]).to_pylist() for f in EVENTS.split(", ")), strict=True):
                if which != now:
                    if sweep:
                        told()
                    now, sweep = which, _Sweep(own, spelled)
                sweep.read(side, start, sound, ids)
            if len(rows) >= 256:
                yield batch_of()
        if sweep:
            told()
        if rows:
            yield batch_of()

    return settle(ordered.mapInArrow(run, ALIGNED)), words


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents of a batch: the row, the pair's number and how often it is linked."""
    gaps, times = batch.column("pairs").to_pylist(), batch.column("times").to_pylist()
    sizes = np.array([len(g) // 4 for g in gaps], np.int64)
    total = np.cumsum(np.frombuffer(b"".join(gaps), np.uint32).astype(np.int64))
    first = np.cumsum(sizes) - sizes
    base = np.where(first > 0, total[first - 1], 0) if len(total) else np.zeros(len(sizes), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, total - base[row], np.frombuffer(b"".join(times), np.uint32).astype(np.int64)


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """pair (number) and n, its links in all documents; a task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_pairs, np.int64)
        for batch in batches:
            _, pair, times = _pairs_of(batch)
            np.add.at(n, pair, times)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some, pa.int64()), "n": pa.array(n[some])})

    return aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def summarise(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. See align for nulls, repeats and long texts."""
    aligned, words = align(docs, a_file, b_file)
    found = pair_counts(aligned, len(words.pairs)).toArrow()  # at most the pairs that the vocabularies allow
    count = np.zeros(len(words.pairs), np.int64)
    count[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    highest = np.zeros(words.n_b, np.int64)
    np.maximum.at(highest, words.b_of_pair, count)
    shared = docs.sparkSession.sparkContext.broadcast((count, count == highest[words.b_of_pair]))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            row, pair, times = _pairs_of(batch)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, times * best[pair])
            np.add.at(sums[1], row, times * count[pair])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *map(pa.array, sums)], [*plain, "n_best", "count_sum"])

    out = aligned.mapInArrow(run, ", ".join([f for f in ALIGNED.split(", ") if f.split()[0] in plain] + ["n_best long", "count_sum long"]))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return summarise(table(spark, sf_dir, "documents"))
