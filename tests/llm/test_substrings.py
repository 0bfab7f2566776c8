import hashlib
import random
from collections import Counter

from loomfold.llm import substrings


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((d if d is not None else -1, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(rng):
    letters = "abcdeé "
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [fresh(n) for n in (199, 200, 201, 350, 900)]
    rows = [(None, None), (1, ""), (2, "x" * 150), (3, "ab" * 400), (4, "long " * 300)]
    for k in range(5, 60):
        parts = [fresh(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 4)], fresh(rng.randint(0, 250))]
        rows.append((k, "".join(parts)))
    rows += [(70, rows[10][1]), (10, rows[10][1]), (10, rows[10][1]), (71, rows[20][1][:-30] + "changed" + rows[20][1][-20:])]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 200)
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    for hot, bits in ((20_000, 20), (1, 20), (20_000, 9)):
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "CHUNK_BITS", bits)
        monkeypatch.setattr(substrings, "_CACHE", {})
        got = substrings.query(docs).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in columns)) for r in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, spans string")
    assert substrings.query(docs).count() == 0
