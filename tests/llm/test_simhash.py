import random
from collections import Counter

import xxhash

from loomfold.llm import simhash


def brute_print(text, shingle=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def docs_of(rng, n):
    vocabulary = [f"w{k}" for k in range(300)]
    rows, texts = [], []
    for k in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts[-20:]).split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))
        texts.append(text)
        rows.append((k, text))
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    rows = [*docs_of(rng, 250), (900, None), (901, ""), (902, " \t"), (903, "É a\x0bB"), (904, "É A b"), (3, "again the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cell, radius in ((1 << 18, 3), (40, 3), (1 << 18, 9)):
        monkeypatch.setattr(simhash, "CELL", cell)
        got = simhash.near_dups(docs, radius=radius).collect()
        prints = {}
        for k, (d, text) in enumerate(rows):
            prints[(d, k)] = brute_print(text)
        want = {key: root[0] for key, root in brute_components(prints, radius).items()}
        assert sorted((r["doc_id"], r["fp0"] & (1 << 64) - 1, r["component_id"]) for r in got) == sorted((d, prints[(d, k)], want[(d, k)]) for (d, k) in prints)


def test_similarity_links_edited_copies_only(spark):
    rng = random.Random(1)
    base = [f"v{rng.randrange(5000)}" for _ in range(400)]
    near = list(base)
    near[50] = near[300] = "changed"
    other = [f"v{rng.randrange(5000)}" for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dups(docs, shingle=5, similarity=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fp0 string, node int")
    assert simhash.near_dups(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "x", 1)], "doc_id long, text string, fp0 string, component_id int")
    assert simhash.query(docs).columns == ["doc_id", "fingerprint", "component_id"]


def bag(text, shingle=5):
    words = (text or "").lower().split()
    return Counter(tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))) if words else Counter()


def test_similarity_is_that_of_the_shingles(spark, monkeypatch):
    """Pairs of 0.72 to 0.9, brute force over all pairs; one text repeats a line, so that bags and sets differ."""
    rng, rows = random.Random(5), []
    for _ in range(40):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for share in (0, 0.012, 0.02, 0.024, 0.028, 0.034):
            words = list(base)
            for at in rng.sample(range(len(base)), int(share * len(base))):
                words[at] = "changed"
            rows.append((len(rows), " ".join(words)))
    line = "one two three four five six seven eight nine "
    rows += [(len(rows), line * 30 + "x"), (len(rows) + 1, line * 25 + "x"), (len(rows) + 2, line * 10 + "x")]
    bags = {d: bag(t) for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    near = 0
    for a, x in bags.items():
        for b, y in bags.items():
            if a < b and (both := (x & y).total()) and both / (x | y).total() >= 0.8 - 1e-9:
                near += both / (x | y).total() < 0.85
                u, v = sorted((find(a), find(b)))
                root[v] = u
    assert near > 20  # below 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (simhash.MOST, 4):  # then groups are cut into blocks
        monkeypatch.setattr(simhash, "MOST", most)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_dups(docs, shingle=5, similarity=0.8).collect()}
        assert got == {d: find(d) for d in root}
