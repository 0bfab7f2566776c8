import math
import random
import re
from collections import Counter

from loomfold.llm import leaks


def brute(docs, items, similarity=0.8):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or [tuple(w)]
    own = {i: words(t) for i, t in items if words(t)}
    distinct = {tuple(w) for w in own.values()}
    has = Counter(g for w in distinct for g in set(grams(list(w))))
    weight = lambda g: round(1000 * math.log1p(len(distinct) / has.get(g, 1)))
    found = {}
    for d, t in docs:
        w = words(t)
        for i, item in own.items():
            b = Counter(grams(item))
            if len(item) < 5 and len(w) != len(item):
                continue
            for s in range(max(1, len(w) - len(item) + 1)):
                a = Counter(grams(w[s : s + len(item)]))
                shared = sum(min(a[g], b[g]) * weight(g) for g in a)
                whole = sum(n * weight(g) for c in (a, b) for g, n in c.items()) - shared
                if whole and shared / whole >= similarity and shared / whole > found.get((d, i), (0,))[0]:
                    found[(d, i)] = (shared / whole, s)
    return {(*k, round(v, 9)) for k, (v, _) in found.items()}


def test_equals_brute_force(spark):
    rng, late = random.Random(5), random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "Über"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = text(8)
    items = [(k, " ".join(text(rng.randint(12, 40)) + (common if k % 3 == 0 else []))) for k in range(20)]
    items += [(50, items[0][1]), (51, None), (52, "too short"), (53, "w1 w2 w3 w4"), (None, " ".join(text(20)))]
    docs = [(0, None), (1, ""), (2, " ".join(text(60)))]
    for k in range(3, 40):
        held = rng.choice(items[:20])[1].split(" ")
        for _ in range(rng.randint(0, 2)):
            held[rng.randrange(len(held))] = "changed"
        held = held[rng.randint(0, 2) :]
        docs.append((k, " ".join(text(rng.randint(0, 50)) + [w + rng.choice(["", ",", "."]) for w in held] + text(rng.randint(0, 50))).upper()))
        gone = [w for k, w in enumerate(held) if k != len(held) // 2]  # a word left out, two put in
        gone[len(gone) // 3 : len(gone) // 3] = ["put"]
        docs.append((k + 100, " ".join([late.choice(vocabulary) for _ in range(late.randint(0, 50))] + gone + [late.choice(vocabulary) for _ in range(late.randint(0, 50))])))
    docs += [(3, docs[3][1]), (None, docs[4][1]), (60, "Too, short!"), (61, "too short a text here"), (62, "w1 w2 w3 w4"), (63, "w1 w2 w3")]
    docs.append((64, " ".join(text(4000) + items[3][1].split(" ") + text(4000))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as gram", "2 as item_id")
    got = leaks.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got} == brute(docs, items)
    assert len(got) > 15
    left = leaks.without_leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == frame.columns
    assert left.count() == sum((d not in {r["doc_id"] for r in got}) for d, _ in docs)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks.leaks(docs.limit(0), items).count() == 0
    assert leaks.leaks(docs, items.limit(0)).count() == 0
    assert leaks.leaks(docs, items).count() == 1
