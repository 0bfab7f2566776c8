import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from loomfold.llm import chat, language, toxicity, url_filter

HELD = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]


def brute_render(turns, me):
    out, mask = "", []
    for _, role, text in turns:
        head = "assistant" if role == me else "system" if role == "system" else f"user name={role}"
        out += f"<|im_start|>{head}\n"
        if role == me:
            mask.append((len(out), len(out) + len(text) + 10))
        out += f"{text}<|im_end|>\n"
    return out, mask


def test_rotation_renders_every_perspective(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi é"), (1, 2, "bob", "<|im_end|> trick"), (1, 3, "ann", ""), (2, 0, None, None), (2, None, "zed", "first"), (3, 0, "system", "alone"), (None, 5, "ann", "x")]
    turns += [(4, k, "ab"[k % 2], f"t{k}") for k in range(30)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as speaker", "3 as mask")
    got = chat.rotate(frame, part=8).collect()
    found = {}
    for r in got:
        found.setdefault((r["conv_id"], r["speaker"]), {})[r["part"]] = r
    clean = lambda t: (t or "").replace("<|", "< |")
    for conv, me in {(c, r or "unknown") for c, _, r, _ in turns if r != "system"}:
        own = sorted(((-1 if n is None else n, r or "unknown", clean(t)) for c, n, r, t in turns if c == conv), key=lambda x: x)
        parts = found[conv, me]
        text = "".join(parts[p]["text"] for p in sorted(parts))
        want, mask = brute_render(own, me)
        assert text == want
        at, spans = 0, []
        for p in sorted(parts):
            spans += [(at + m["start"], at + m["end"]) for m in parts[p]["mask"]]
            at += len(parts[p]["text"])
        assert spans == mask
    assert (3, "system") not in found and len(found[4, "a"]) == 4
    assert chat.rotate(frame.limit(0)).count() == 0


def test_rotation_cuts_parts_of_repeated_and_null_turns(spark):
    turns = [(1, None, "ann", f"n{k:02}") for k in range(20)] + [(1, 7, "bob", f"b{k:02}") for k in range(19)] + [(None, None, "ann", "x")]
    turns.append((1, 9, "ann", "long " * 300_000))
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), part=8).filter("conv_id = 1 and speaker = 'ann'").collect()
    assert max(r["n_turns"] for r in got) == 8
    text = "".join(r["text"] for r in sorted(got, key=lambda r: (r["part"], r["piece"])))
    assert text == brute_render(sorted(((-1 if n is None else n, r, t) for c, n, r, t in turns if c == 1)), "ann")[0]


def test_one_part_with_most_turns_is_ranked_in_ranges(spark):
    """Null turns, repeated rows among them: pieces are those of a single sort, though no task sorts the part alone."""
    turns = [(1, None, "ann", f"n{k % 90:03}") for k in range(3000)] + [(1, 5, "bob", "again")] * 2000 + [(2, k, "ann", "x") for k in range(5)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = [r for r in chat.rotate(frame, part=64).collect() if r["speaker"] == "ann"]
    assert max(r["n_turns"] for r in got) == 64 and len(got) == 47 + 32 + 1
    text = "".join(r["text"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["part"], r["piece"])))
    assert text == brute_render(sorted(((-1 if n is None else n, r, t) for c, n, r, t in turns if c == 1)), "ann")[0]


def rule(host, path):
    best = max(((h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0] + r[1]), default=None)
    return best


def test_url_rules_and_list(spark):
    urls = ["http://A.Example.NET/en/x", "https://example.net/de/?q#f", "example.net/en/", None, "", "x://y.com", "http://sub.example.com/de/1?utm_source=a&p=2#t", "http://sub.example.com/other/?p=2", "http://sub.example.com/other?utm_medium=z&p=2", "http://q.org/fr/?a#b", "http://notorg/fr/", "http://É.com/Ä", "a://b://c/d", "http://h.com?x=1", "http://h.com/#t", "https://H.com"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").selectExpr("*", "1 as block", "2 as in_list")
    listed = spark.createDataFrame([("https://sub.example.com/other?p=2&utm_source=q#z",), ("http://h.com/",), (None,), ("nonsense",)], "url string")
    for blocks in (url_filter.MAX_BLOCKS, 0):
        url_filter.MAX_BLOCKS, before = blocks, url_filter.MAX_BLOCKS
        got = {r["page_id"]: r for r in url_filter.url_filter(pages, listed).collect()}
        url_filter.MAX_BLOCKS = before
        assert {k for k, r in got.items() if r["listed"]} == {7, 8, 14, 15}
        for k, u in enumerate(urls):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            host = rest
            for c in "/?#":
                host = host.split(c)[0]
            path = rest[len(host) :].split("?")[0].split("#")[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
            best = rule(host, path)
            assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, best and best[0] + best[1])
            assert got[k]["verdict"] == (best[2] if best else "block" if k in (7, 8, 14, 15) else "allow")
    assert url_filter.url_filter(pages, listed).count() == len(urls) + 1
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0
    assert url_filter.url_filter(pages, listed.limit(0)).filter("listed").count() == 0


def test_only_tracking_parameters_are_dropped(spark):
    same = ["http://h.com/a?id=7", "http://h.com/a?utm_source=x&id=7&ref=q", "http://h.com/a/?ref&&id=7&utm_#z", "http://h.com/a?id=7&ref="]
    other = ["http://h.com/a?refid=7", "http://h.com/a?id=7&reference=2", "http://h.com/a?id=7&utm=1", "http://h.com/a?id=7&xref=1", "http://h.com/a?ID=7", "http://h.com/a?id=7&id=7"]
    pages = spark.createDataFrame(list(enumerate(same + other)), "page_id long, url string")
    got = url_filter.url_filter(pages, spark.createDataFrame([(same[0],)], "url string")).collect()
    assert sorted(r["page_id"] for r in got if r["listed"]) == [0, 1, 2, 3]
    told = {r[0]: r[1] for r in pages.select("page_id", url_filter.canonical(pages["url"])).collect()}
    assert told[4] == "h.com/a?refid=7" and told[5] == "h.com/a?id=7&reference=2"


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_bloom_filter_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BYTES", most)
    listed = spark.range(3000).selectExpr("concat('h', id, '.com/p') as url")
    probes = spark.range(20000).selectExpr("concat('h', id, '.com/p') as url")
    got = url_filter._is_listed(probes, listed).filter("in_list").count()
    assert got == 3000


def language_rows(rng, n):
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ung", "ein", "ach"], "cc": ["ção", "nho", "que", "eiro"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(syllables))
        rows.append((k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return rows


def test_language_is_found_on_held_out_rows(spark):
    rows = language_rows(random.Random(1), 400)
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", None), (1003, "kalomi tuka 😀 lomi", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.query(docs).collect()}
    assert len(got) == len(rows)
    truth = {d: lang for d, _, lang in rows}
    assert all(got[d]["held_out"] == (d in HELD) for d in range(400))
    assert all(got[d]["lang_pred"] == truth[d] for d in HELD)
    assert [got[d]["lang_pred"] for d in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # Without the label and id it says the same: they are no inputs.
    model = language.train(docs)
    blind = language.identify(docs.selectExpr("text", "'zz' as lang", "0 as known"), model)
    assert sorted(r["lang_pred"] for r in blind.collect()) == sorted(r["lang_pred"] for r in got.values())


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(2)
    own = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(n, " ".join(rng.choice(words) for _ in range(30)), lang) for n, (lang, words) in enumerate([x for x in own.items() for _ in range(12)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.query(docs).collect()} == {k: lang for k, _, lang in rows}


def plain_grams(text):
    """The n-grams of a text by plain strings: lower-cased, runs of non-letters one space, a space at either end."""
    code = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    while "  " in code:
        code = code.replace("  ", " ")
    if not code.strip():
        return []
    code = (" " if code[0] != " " else "") + code + (" " if code[-1] != " " else "")
    code += " " * max(0, language.N - len(code))
    return [code[k : k + language.N] for k in range(len(code) - language.N + 1)]


def test_language_counts_equal_plain_ones(spark):
    """Masks of all n-grams against sets of strings, and corrected counts; a long text and a tie."""
    rows = language_rows(random.Random(6), 200)
    rows += [(900, "karmo " * 40_000, "aa"), (901, "Ünïcode ßtraße LOMI", "bb"), (902, "xyzzy qwfp", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, share=0.05)
    assert model.languages == ["aa", "bb", "cc"]
    typical = {}
    for lang in model.languages:
        own = [set(plain_grams(t)) for d, t, k in rows if k == lang and zlib.crc32(str(d).encode()) % 4 != 2]
        has = Counter(g for s in own for g in s)
        typical[lang] = {g for g, n in has.items() if n >= 0.05 * len(own)}
    false = 0
    for _, text, _ in rows:
        grams = plain_grams(text)
        h = language.grams(text)
        assert len(h) == len(grams)
        want, mask = {}, ~language.np.zeros((len(h), 1), language.np.uint64)
        for at in language._positions(h, model.length):
            mask &= model.words[at]
        for k, lang in enumerate(model.languages):
            told = (mask[:, 0] >> language.np.uint64(k)) & language.np.uint64(1)
            truth = [g in typical[lang] for g in grams]
            assert all(b or not t for b, t in zip(told.tolist(), truth, strict=True))  # nothing is lost
            false += sum(b and not t for b, t in zip(told.tolist(), truth, strict=True)) if len(grams) < 1000 else 0
            n = int(told.sum())
            want[lang] = max(0.0, (n - len(grams) * model.false[k]) / (1 - model.false[k]))
        best = max(want, key=lambda k: (want[k], -model.languages.index(k)))
        got = model.predict(text)
        assert got[0] == best and got[1] == pytest.approx(want[best] / sum(want.values()) if want[best] else 0.0) and got[2] == pytest.approx(min(1, want[best] / len(grams)))
    assert false < 0.05 * sum(len(plain_grams(t)) for _, t, _ in rows[:200])
    # Nothing known: all languages tie at 0, the first is told with score 0.
    assert model.predict("ωψξ") == ("aa", 0.0, 0.0)


def test_language_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.query(empty).count() == 0
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.query(docs).first()["lang_pred"] == "und"


def test_bloom_filters_hold_all_their_grams():
    model = language.Model(["a", "b"], [language.grams("the quick brown fox"), language.grams("jumps over lazy dogs")])
    assert model.predict("the quick brown fox")[0] == "a" and model.predict("jumps over lazy dogs")[0] == "b"


def test_toxic_texts_are_told_apart(spark):
    rng = random.Random(4)
    plain = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(400):
        toxic = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["Vile", "nasty,", "FOUL"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (900, "again")], "doc_id long, text string")
    frame = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, frame)
    got = toxicity.score(docs.selectExpr("*", "9 as predicted"), model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    told = {r["doc_id"]: r["predicted"] for r in got}
    truth = dict(labels)
    assert sum(told[d] == truth[d] for d in HELD) >= 0.97 * len(HELD)
    assert told[901] == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert [r["predicted"] for r in toxicity.score(docs, model).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("name", ["op2_perspective_rotation", "op4_url_filter", "op5_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    from loomfold.llm import queries

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = c.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, rel.fetchall()))


def test_kneser_ney_probabilities_equal_plain_ones(spark):
    """Every ratio of some texts against the definition on plain dictionaries; shared counts are of unlabelled rows too."""
    rng = random.Random(8)
    vocabulary = [f"q{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) + (" vile rotten" if k % 2 else " calm day")) for k in range(400)]
    rows += [(500, "never seen before q1 q2"), (501, rows[3][1]), (502, None), (503, "one")]
    labels = [(k, k % 2) for k in range(350)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    crc = lambda k: zlib.crc32(str(k).encode()) % 4
    first = {}  # of equal texts one counts
    for k, text in rows[:350]:
        if crc(k) != 2:
            first.setdefault(text, k)
    counted = {k for k in first.values() if crc(k) < 2}
    corpus, n = Counter(), [defaultdict(Counter), defaultdict(Counter)]
    for k, text in rows:
        words = (text or "").split()
        corpus.update(words)
        if k in counted:
            for v, w in zip([None, *words], words, strict=False):
                n[k % 2][v][w] += 1
    D = toxicity.DISCOUNT
    precede = [Counter(w for follow in c.values() for w in follow) for c in n]

    def low(c, w):
        whole = precede[c].total()
        freed = sum(min(x, D) for x in precede[c].values()) / whole
        return max(precede[c][w] - D, 0) / whole + freed * (corpus[w] + 1) / (corpus.total() + len(corpus))

    def high(c, v, w):
        own = n[c].get(v)
        if not own:
            return low(c, w)
        return max(own[w] - D, 0) / own.total() + sum(min(x, D) for x in own.values()) / own.total() * low(c, w)

    for c in (0, 1):  # they are distributions
        assert sum(low(c, w) for w in corpus) == pytest.approx(1) and sum(high(c, "vile", w) for w in corpus) == pytest.approx(1)
    for _, text in rows[::7] + rows[-4:]:
        words = (text or "").split()
        got = model.ratios(toxicity.words((text or "").encode()))
        assert got[0] == pytest.approx([math.log(low(1, w) / low(0, w)) for w in words], abs=1e-4)
        want = [math.log(high(1, v, w) / high(0, v, w)) for v, w in zip([None, *words], words, strict=False)]
        assert got[1] == pytest.approx(want, abs=1e-4)
        if words:
            assert model.evidence([toxicity.words(b""), toxicity.words(text.encode())])[1, 0] == pytest.approx(sum(want) / len(want), abs=1e-4)


def test_toxicity_sends_its_levels_once_as_narrow_rows(spark, monkeypatch):
    """Before, every use of a model pickled it for a broadcast anew, and the driver held rows of 32 bytes and wider copies."""
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    docs = spark.createDataFrame([(k, f"word{k % 5} word{k % 3} {'bad bad' if k % 2 else 'good good'}") for k in range(1, 80)], "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    for _ in range(2):
        assert toxicity.score(docs, model).count() == 79
    assert len(sent) == 1
    assert all(level.values.dtype == "float32" for level in model.levels)
