import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomfold.llm import exact_dedup, mixing, shards


def dedup_rows():
    rng = random.Random(2)
    base = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (0, 1, 7, 8, 9, 16, 17, 40, 41, 100)]
    rows = [(k, rng.choice(base)) for k in range(80)]
    spaced = [(100 + k, " " + "\t".join(t) + "\x0b") for k, t in enumerate(base)]
    return [*rows, *spaced, (200, None), (201, ""), (None, base[5]), (3, "another text of the same id"), (4, rows[4][1]), (300, "twice told"), (300, "twicetold"), (301, "a bc"), (301, "ab c"), (301, "a bc"), (None, None), (None, None), (302, "longlong" * 3000), (303, "long long" * 2999 + "longlong"), (302, "longlong" * 3000)]


def brute_dedup(rows):
    groups = defaultdict(list)
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for n, (d, t) in enumerate(rows):
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, hashlib.sha256((t or "").encode()).digest(), n))
    out = []
    for n, (d, t) in enumerate(rows):
        first = min(groups[norm(t)])[-1]
        out.append((d, rows[first][0], len(groups[norm(t)]), n == first, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hashed", [None, lambda c: F.length(c).cast("long") % 3])
def test_exact_dedup_equals_brute_force(spark, hashed):
    rows = dedup_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as name", "1 as width", "2 as i")
    got = exact_dedup.exact_dedup(docs, block=8, **({"hashed": hashed} if hashed else {})).collect()
    assert sorted(map(tuple, got), key=str) == brute_dedup(rows)


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def least_capacity(sizes, n):
    fits = lambda c: all(s <= c for s in sizes) and parts(sizes, c) <= n

    def parts(sizes, c):
        count, room = 1, c
        for s in sizes:
            if s > room:
                count, room = count + 1, c
            room -= s
        return count

    return next(c for c in range(sum(sizes) + 1) if fits(c)) if sizes else 0


@pytest.mark.parametrize("seed", range(4))
def test_minimax_capacity_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(shards, "MAX_OPEN", 2)
    rng = random.Random(seed)
    # Close hashes share units, so units have to be opened.
    hashes = sorted(rng.sample(range(-(2**20), 2**20), 120)) if seed % 2 else sorted({rng.getrandbits(64) - 2**63 for _ in range(120)})
    sizes = [rng.randint(1, 50) for _ in hashes]
    if seed > 1:
        sizes[rng.randrange(120)] = 2000
    groups = spark.createDataFrame(list(zip(hashes, sizes, strict=True)), "h long, bytes long")
    capacity, cuts = shards.minimax_cuts(groups, 7)
    assert capacity == least_capacity(sizes, 7)
    loads = Counter()
    for h, s in zip(hashes, sizes, strict=True):
        loads[sum(h >= c for c in cuts)] += s
    assert max(loads.values()) <= capacity
    if seed < 2:
        assert len(loads) == 7 and max(loads.values()) - min(loads.values()) <= 2 * max(sizes)


def test_shards_hold_every_row_once(spark):
    rng = random.Random(9)
    texts = ["same"] * 40 + ["t" * rng.randint(0, 30) + str(k) for k in range(200)] + [None, "", "é"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (5, texts[5])]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lane", "2 as shard")).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(w) == 1 for w in where.values()) and set(slots) <= set(range(16))
    assert shards.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_are_spread_over_buckets(spark):
    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id", "'a' as source", "concat('w ', id) as text")
    mix = mixing.Mix(docs)
    assert mix.streams().select("h").distinct().count() == 2000 and mix.bucket_bits == 9
    assert mixing.Mix(docs.withColumn("text", F.lit("same words"))).taken().agg(F.sum("taken")).first()[0] == 4000


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    docs = spark.range(5000).selectExpr("id as doc_id", "'a' as source", "'x y' as text")
    mix = mixing.Mix(docs)
    assert mix.bucket_bits == 12 and mix.taken().agg(F.sum("taken")).first()[0] == 10_000


def test_water_fill():
    assert mixing.water_fill([10, 10, 10]) == pytest.approx([18.75, 7.5, 3.75])
    got = mixing.water_fill([10, 100, 1000])
    assert got[:2] == [30.0, 300.0] and got[2] == pytest.approx(780)
    assert mixing.water_fill([]) == [] and mixing.water_fill([0, 0]) == [0.0, 0.0]


@pytest.mark.parametrize("block", [4, 64])
def test_mix_takes_the_quotas(spark, block):
    rng = random.Random(block)
    rows = [(k, rng.choice(["a", "b", "ü", None, "tiny"] if k < 6 else ["a", "b", "ü", None]), " ".join(["w"] * rng.randint(0, 40))) for k in range(150)]
    rows += [(500, "tiny", "one two three"), (501, "none", None), (502, "none", " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "7 as sid", "8 as target")
    mix = mixing.Mix(docs, block=block)
    got = mix.taken().collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    size = {d: len((t or "").split()) for d, _, t in rows}
    source = {d: s for d, s, _ in rows}
    words = Counter()
    for d, s, _ in rows:
        words[s] += size[d]
    order = sorted(words, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.water_fill([words[s] for s in order]), strict=True))
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == words[source[r["doc_id"]]]
        assert r["target"] == targets[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in order)
    # The schedule: every slot once, blocks in order, each stretch mixed like the whole.
    slots = sorted(mix.schedule().collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == sorted({r["slot"] for r in slots})
    by = defaultdict(list)
    for r in slots:
        by[r["sid"]].append(r)
    for own in by.values():
        assert sorted(r["rank"] for r in own) == list(range(len(own)))
    largest = max(by, key=lambda k: len(by[k]))
    share, half = len(by[largest]) / len(slots), slots[: len(slots) // 2]
    assert abs(sum(r["sid"] == largest for r in half) - share * len(half)) <= 4
    assert sorted(map(tuple, mixing.mix(docs.repartition(5), block=block).collect()), key=str) == sorted(map(tuple, got), key=str)


def brute_taken(rows, block):
    """Words taken of each row: every source's shuffled stream as a list of its rows' numbers, a slot at a time."""
    size = [len((t or "").split()) for _, _, t in rows]
    words = Counter()
    for (_, s, _), n in zip(rows, size, strict=True):
        words[s] += n
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight, left, target, free = (5, 2, 1), float(sum(size)), {}, list(range(len(order)))
    while free:  # by plain resharing
        whole = sum(weight[k % 3] for k in free)
        share = {k: left * weight[k % 3] / whole for k in free}
        full = [k for k in free if share[k] > 3 * words[order[k]]]
        for k in full or free:
            target[k] = 3.0 * words[order[k]] if full else share[k]
        left -= sum(target[k] for k in full)
        free = [k for k in free if k not in full] if full else []
    return {order[k]: min(int(t + 0.5), 3 * words[order[k]]) for k, t in target.items()}, size


@pytest.mark.parametrize("block", [4, 64])
def test_taken_of_each_document_equals_brute_force(spark, block):
    rng = random.Random(20 + block)
    rows = [(k % 90, rng.choice(["a", "b", "ü", None, "small"] if k < 9 else ["a", "b", "ü", None]), " ".join(["w"] * rng.randint(0, 50)) + f" x{k}") for k in range(160)]
    rows += [(7, "a", rows[7][2]), (500, "b", "long " * 60_000), (None, "a", "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.Mix(docs, block=block)
    quota, size = brute_taken(rows, block)
    placed = {}
    for r in mix.streams().filter("size > 0").collect():
        placed.setdefault(r["sid"], []).append((r["first_word"], r["doc_id"], r["size"]))
    names = {k: s for k, s, _, _ in mix.sources}
    want = Counter()
    for sid, own in placed.items():
        stream = [n for n, (_, _, w) in enumerate(sorted(own, key=lambda x: x[0])) for _ in range(w)]
        docs_of = sorted(own, key=lambda x: x[0])
        assert [f for f, _, _ in docs_of] == [sum(w for _, _, w in docs_of[:k]) for k in range(len(docs_of))]  # one stream without gaps
        times, rest = divmod(quota[names[sid]], len(stream))
        for at, n in enumerate(stream):
            want[sid, docs_of[n][0]] += times + (at < rest)
    got = Counter()
    by_place = {(sid, d, w): [] for sid, own in placed.items() for f, d, w in own}
    for sid, own in placed.items():
        for f, d, w in own:
            by_place[sid, d, w].append(want[sid, f])
    found = {}
    for r in mix.taken().filter("size > 0").collect():
        sid = next(k for k, s, total, _ in mix.sources if total == r["source_size"] and (k, r["doc_id"], r["size"]) in by_place)
        found.setdefault((sid, r["doc_id"], r["size"]), []).append(r["taken"])
        got[sid] += r["taken"]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by_place.items()}
    assert {names[k]: n for k, n in got.items()} == {s: q for s, q in quota.items() if q}


def test_mix_ignores_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], "w " * k) for k in range(1, 30)], "doc_id long, source string, text string")
    clash = docs.selectExpr("*", "1 as source_size", "2 as bucket", "3 as blk", "4 as h", "5 as key", "6 as size", "7 as taken")
    assert sorted(map(tuple, mixing.mix(clash).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_mix_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty).columns == ["doc_id", "size", "source_size", "target", "taken"]
