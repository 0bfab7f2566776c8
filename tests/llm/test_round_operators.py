"""Host rules, centroid clustering and alignment against plain versions."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomfold.llm import alignment, clusters, host_rules

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"


def plain_measures(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), len(re.sub(SPACE, "", text)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t\x0b", "a b c a b c", "a a a a", "x\x1cy\x85z é   q", "#*$%&|<>@\n#*$%&|<>@\n \n \n", "é\r\né\r\n", "one two"] + [" ".join(random.Random(k).choices("abcdé", k=60)) for k in range(20)]


@pytest.mark.parametrize("text", TEXTS)
def test_measures_equal_plain(text):
    assert host_rules.measured(text) == plain_measures(text)


def test_very_long_text_is_measured_whole():
    words = [f"w{k}" for k in range(400_000)] + ["w0", "w1", "w2"]
    assert host_rules.measured(" ".join(words))[-1] == 6


def documents():
    clean = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, clean(k), "good") for k in range(40)] + [(100 + k, clean(k) if k % 10 == 0 else f"short {k}", "bad") for k in range(40)]
    rows += [(200, "too short", "once"), (201, clean(7), "once2"), (202, clean(8), None), (203, None, None), (None, None, "good"), (204, "", "bad"), (0, clean(0), "good"), (0, clean(0), "good")]
    rows += [(300 + k, t, f"h{k % 5}") for k, t in enumerate(TEXTS)]
    rows += [(400 + 10 * h + k, clean(h * k), f"g{h}") for h in range(8) for k in range(6)]
    return rows


@pytest.mark.parametrize("hosts", [100_000, 0])
def test_host_rules_equal_sql(spark, hosts, monkeypatch):
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", hosts)
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "2 as kept", "3 as rule", "4 as n")
    d = duckdb.connect()
    frame = docs.toArrow()
    d.register("documents", frame)
    got = sorted(map(str, (tuple(r) for r in host_rules.query(docs).collect())))
    assert got == sorted(map(str, d.execute(host_rules.ORACLE_SQL).fetchall()))
    found = [r.asDict() for r in host_rules.judge(docs).collect()]
    assert all(r["kept"] for r in found if r["source"] == "good" and r["doc_id"] is not None)
    assert not any(r["kept"] for r in found if r["source"] == "bad")
    # One short document alone does not condemn its host, nor does a null source stand for a host.
    assert [r["host_rejected"] for r in found if r["doc_id"] in (200, 201, 202, 203)] == [False] * 4
    assert host_rules.query(docs.limit(0)).count() == 0


def plain_clusters(rows, k=clusters.K, rounds=clusters.ROUNDS):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda r: ("~",) if r[0] is None else (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=mark)[:k]]
    place = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = place()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    own = place()
    inertia = Counter()
    for d, c in own:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(str((i, c, d, inertia[c], sum(inertia.values()), sha[c])) for (i, _), (d, c) in zip(kept, own))


def vectors(n, seed):
    r = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in r.normal(r.integers(0, 3), 1, 64).astype(np.float32)]) for k in range(n)]
    ones = [0.5] * 64
    return rows + [(1, ones), (1, ones), (1000, None), (1001, [1.0] * 63), (1002, [1.0] * 65), (1003, [None] + ones[1:]), (1004, [float("nan")] + ones[1:]), (1005, [float("inf")] + ones[1:]), (1006, [-0.00001] * 64)]


def test_clusters_equal_plain(spark):
    for rows in (vectors(150, 1), vectors(2, 2)[:4], [(k, [1.0] * 64) for k in range(12)] + [(20, [-1.0] * 64)]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "2 as v", "3 as packed")
        assert sorted(str(tuple(r)) for r in clusters.cluster(frame).collect()) == plain_clusters(rows)
    assert clusters.cluster(frame.limit(0)).count() == 0


def test_screen_leaves_out_centroids_and_never_the_nearest():
    r = np.random.default_rng(0)
    centroids = r.integers(-900, 900, (8, 64))
    v = centroids[r.integers(0, 8, 4000)] + r.integers(-40, 40, (4000, 64))
    best, least, measured = clusters.nearest(v, clusters._norms(v), centroids)
    d = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (least == d.min(axis=1)).all() and (best == d.argmin(axis=1)).all() and measured < 2 * len(v)
    same = np.array([[5] * 64, [5] * 64, [7] * 64])
    assert clusters.nearest(np.array([[6] * 64]), clusters._norms(np.array([[6] * 64])), same)[0].tolist() == [0]


def test_vector_too_large_is_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(frame).collect()


HARD = [
    None, "", " ", "a", "  a", "a  ", "a\n b", "a \n b \t c", "x<|endoftext|>y <s> a </s><unk>", "it's  we'll ok   z", "naïve façade Straße", "日本語 テキスト 한국어", "🙂🙂 👩‍👩‍👧", "▁ a▁b", "\x00\x01 \x1c x",
    "a" * 3000, " " * 50, "é ﬁ", "​ x", "1234567890 12,5", "\U00010e60\U0001e900", "tab\t\ttab", "\r\n\r\nx", "a\x1c b\x85 c",
]


def plain_alignment(rows, words_a, words_b):
    a_coder, b_coder = alignment.ByteLevel(alignment.A_FILE), alignment.Pieces(alignment.B_FILE)
    docs, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_coder.coder.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_coder.coder.encode(text or "")
        if not text or b"".join(words_a[k] for k in a) != whole or b"".join(words_b[k] for k in b) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(words_a[k]) for k in a]).tolist(), np.cumsum([len(words_b[k]) for k in b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups = [([k for k, e in zip(a, ends_a) if i < e <= j], [k for k, e in zip(b, ends_b) if i < e <= j]) for i, j in zip([0, *common], common)]
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_alignment_equals_plain(spark, monkeypatch):
    r = random.Random(3)
    rows = list(enumerate(HARD)) + [(100 + k, " ".join("".join(r.choices("abcdeéß'.,7 \n", k=r.randint(0, 12))) for _ in range(80))) for k in range(12)]
    rows += [(7, "same id, other text"), (None, "no id"), (None, "no id"), (None, "another"), (None, None), (0, None), (0, None), (3, "a"), (200, "the long and winding road " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as start", "3 as ids", "4 as side")
    a, b = alignment.ByteLevel(alignment.A_FILE).tokens, alignment.Pieces(alignment.B_FILE).tokens
    for run in (alignment.RUN, 7):  # rows of a few tokens, so groups cross them
        monkeypatch.setattr(alignment, "RUN", run)
        got = sorted((tuple(x) for x in alignment.summarise(docs).collect()), key=str)
        assert got == plain_alignment(rows, a, b)
    assert alignment.summarise(docs.limit(0)).count() == 0


def test_segments_give_the_tokens_of_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 40)
    coders = alignment.Coders(alignment.A_FILE, alignment.B_FILE)
    r = random.Random(5)
    texts = [t for t in HARD if t] + ["".join(r.choices(["a", "Z", " ", "  ", "\n", "\t", "'s", "é", "日", "1", "-", " ", "▁", "<s>"], k=60)) for _ in range(300)]
    for text, (a, b) in zip(texts, coders(texts), strict=True):
        assert np.frombuffer(a, np.uint16).tolist() == coders.sides[0].coder.encode(" " + text, add_special_tokens=False).ids
        ids = coders.sides[1].coder.encode(text)
        whole = b"".join(coders.sides[1].tokens[k] for k in ids)
        assert (b is None) == (whole != (" " + text).encode()) and (b is None or np.frombuffer(b, np.uint16).tolist() == ids)


def test_linked_pairs_are_bounded_by_the_vocabularies():
    words = alignment.Vocabularies([b"a", b"ba", b"cb"], [b"a", b"ca", b"b"])
    assert words.pairs.tolist() == [0, 1, 3, 8]  # a-a, a-ca, ba-a, cb-b


def test_very_long_texts_are_handled_whole(spark):
    """One text of two megabytes and its copy with an end of its own, among short ones: shards, near duplicates, sources and addresses."""
    from loomfold.llm import mixing, shards, simhash, url_filter

    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, long, "a"), (2, long + " and more", "a"), (3, "short text", "a"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in shards.shard(docs).collect()} == {d: len(t or "") + 1 for d, t, _ in rows}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_dups(docs, shingle=5, similarity=0.8).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: 300_000, 2: 300_002, 3: 2, 4: 0}
    url = "http://example.com/de/" + "x" * 1_000_000
    found = url_filter.url_filter(spark.createDataFrame([(1, url)], "page_id long, url string"), docs.selectExpr("text as url").limit(0)).first()
    assert (len(found["path"]), found["rule"], found["verdict"]) == (len(url) - 18, "example.com/de/", "block")
