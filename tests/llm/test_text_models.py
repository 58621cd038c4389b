import random
import re
import zlib
from collections import Counter

import numpy as np

from stratafold.llm import decontaminate, language, lm, pii

EM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CA = re.compile(r"[0-9]([\x20-]?[0-9])+")
PH = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    n = lambda m: len(pii.digits_of(m[0]))
    out = [("email", *m.span()) for m in EM.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(a) <= 255 for a in m[0].split("."))]
    out += [("card", *m.span()) for m in CA.finditer(t) if 13 <= n(m) <= 19 and pii.luhn(pii.digits_of(m[0]))]
    return out + [("phone", *m.span()) for m in PH.finditer(t) if 9 <= n(m) <= 15]


def test_base_spans_equal_patterns():
    rnd = random.Random(2)
    for _ in range(20000):
        t = "".join(rnd.choice("00123@@..--++() aB%") for _ in range(rnd.choice([10, 40])))
        assert brute_spans(t) == pii.base_spans(t)
    assert pii.base_spans("9" * 50000 + "x" * 50000 + "@") == []


def test_gradients():
    rng = np.random.default_rng(0)
    p, x, y = pii.init(rng), rng.integers(0, pii.CLASSES, (3, 8)), rng.integers(0, pii.TAGS, (3, 8))
    loss, g = pii.gradients(p, x, y)
    for k in p:
        i = (int(x[0, 3]), 5) if k[0] == "x" else tuple(0 for _ in p[k].shape)
        q = {a: b.copy() for a, b in p.items()}
        q[k][i] += 1e-5
        assert abs((pii.gradients(q, x, y)[0] - loss) / 1e-5 - g[k][i]) < 1e-4


def test_model_finds_held_out_spans():
    p = pii.fit(*pii.drawn(900), steps=120)
    x, y = pii.drawn(200, seed=99)
    kinds = lambda t: (t + 1) // 2
    want, got = kinds(y), kinds(pii.decode(p, x))
    assert (want == got).mean() > 0.97
    text = "word " * 30 + "call +1 (988) 555-2485 now " + "word " * 30
    base, every = pii.spans_of(p, [text])[0]
    assert base == [("phone", 155, 172)] and set(base) <= set(every)
    assert pii.spans_of(p, ["", "no digits here"]) == [([], []), ([], [])]


def test_precision_of_held_out_spans():
    p = pii.fit(*pii.drawn(900), steps=120)
    x, y = pii.drawn(300, seed=123)
    got = pii.decode(p, x)

    def spans(tags):
        out = set()
        for r, row in enumerate((tags + 1) // 2):
            cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
            out |= {(r, a, b, int(row[a])) for a, b in zip(cuts[:-1], cuts[1:]) if row[a]}
        return out

    want, found = spans(y), spans(got)
    assert len(want) > 100 and len(want & found) / len(found) > 0.85 and len(want & found) / len(want) > 0.85
    clean = ["in 1999 there were 12 of 345 items, version 3.14, page 7 of 10, ratio 3:2, room 101 @ home"] * 20
    assert sum(len(e) for _, e in pii.spans_of(p, clean)) == 0


def planted(rng):
    """Texts with forms that the patterns miss, and with numbers that are none; the exact spans wanted."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuéñ") for _ in range(rng.randint(2, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    words = lambda k: " ".join(word() for _ in range(k))

    def card(good=True):
        while True:
            s = num(16)
            if pii.luhn(s) == good and len(set(s)) > 4:
                return s

    what = [("email", f"{word().encode('ascii', 'ignore').decode()}xy (at) example (dot) com"), ("phone", f"({num(3)}) {num(3)}-{num(4)}"), ("ip", "[.]".join(str(rng.randint(1, 255)) for _ in range(4))),
            ("card", ".".join(re.findall("....", card()))), (None, card(False)), (None, f"{num(4)}-{num(2)}-{num(2)}"), (None, num(8)), (None, f"{num(2)}.{num(3)}")]
    text, spans = words(rng.randint(3, 30)), []
    for kind, s in rng.sample(what, 5):
        text += " "
        if kind:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s + " " + words(rng.randint(10, 40))
    return text, spans


def test_precision_of_added_spans():
    p, rng = pii.fit(*pii.drawn(1500)), random.Random(4)
    texts = [planted(rng) for _ in range(150)]
    added = wanted = right = 0
    for (text, want), (base, every) in zip(texts, pii.spans_of(p, [t for t, _ in texts]), strict=True):
        new = set(every) - set(base)
        added, wanted, right = added + len(new), wanted + len(set(want) - set(base)), right + len(new & set(want))
        assert set(base) <= set(every)
    assert right / added >= 0.9 and right / wanted >= 0.6, (added, wanted, right)
    failing = [f"word {n} word" for n in (str(10**15 + k * 7919) for k in range(400)) if not pii.luhn(n)]
    assert not any(every for _, every in pii.spans_of(p, failing))


def slow_spans(p, text):
    """Every window decoded by trying tags in plain loops, every character's tag from its most central window."""
    x, best = pii.classes(text), [(-1, 0)] * len(text)
    for a in pii.starts(len(text)):
        part = [*x[a : a + pii.SPAN].tolist()]
        part += [pii.PAD] * (pii.SPAN - len(part))
        tags = [0] * pii.SPAN
        if pii._trigger.search(text[a : a + pii.SPAN]) or any(a <= m.start() < a + pii.SPAN for m in pii._trigger.finditer(text)):
            e = pii.unary(p, np.array([part]))[0][:, 0]
            score, back = list(p["s"] + e[0]), []
            for t in range(1, pii.SPAN):
                came = [max(range(pii.TAGS), key=lambda i: (score[i] + p["t"][i][j], -i)) for j in range(pii.TAGS)]  # noqa: B023
                score = [score[came[j]] + p["t"][came[j]][j] + e[t][j] for j in range(pii.TAGS)]
                back.append(came)
            tags[-1] = max(range(pii.TAGS), key=lambda i: (score[i], -i))
            for t in range(pii.SPAN - 1, 0, -1):
                tags[t - 1] = back[t - 1][tags[t]]
        for d in range(min(pii.SPAN, len(text) - a)):
            central = pii.SPAN / 2 - abs(d - (pii.SPAN - 1) / 2) + (pii.SPAN if a == 0 and d < pii.SPAN // 2 else 0)
            if central > best[a + d][0]:
                best[a + d] = (central, tags[d])
    out, k = [], 0
    while k < len(text):
        kind, e = (best[k][1] + 1) // 2, k + 1
        while e < len(text) and (best[e][1] + 1) // 2 == kind and best[e][1] % 2 == 0:
            e += 1
        if kind:
            out.append((pii.KINDS[kind - 1], k, e))
        k = e
    return out


def test_spans_equal_slow_decoder():
    p, rng = pii.fit(*pii.drawn(400), steps=40), random.Random(6)
    texts = [planted(rng)[0] for _ in range(12)] + ["", "no", "a1", "x" * 63 + "1" + "y" * 64, "me (at) home " * 9, "1" * 64, "4" * 100]
    for text, got, (base, every) in zip(texts, pii.model_spans(p, texts), pii.spans_of(p, texts), strict=True):
        assert got == (slow_spans(p, text) if pii._trigger.search(text) else [])
        for kind, a, b in set(every) - set(base):
            assert pii.plausible(kind, text[a:b]) and (kind, a, b) in pii.candidates(text, got)
            assert not (b < len(text) and text[b].isdigit() and text[b - 1].isdigit()) and not (a and text[a - 1].isdigit() and text[a].isdigit())


def test_find_takes_odd_rows(spark, odd_docs, no_docs):
    p = pii.init(np.random.default_rng(0))
    text = "a" * 70000 + " mail me@x.org now " + "7" * 3000
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, text), (50, text)], "doc_id long, text string")).selectExpr("*", "'clash' as spans")
    got = pii.find(docs, p)
    assert got.count() == 12 and pii.find(no_docs, p).count() == 0


def test_many_languages_and_unspaced_scripts(spark, odd_docs):
    rng = np.random.default_rng(1)
    scores = [rng.normal(0, 3, (9, 200)).astype(np.float32)]
    path = language.label(scores, 2.0)[0]
    assert path.max() > 127 or path.min() >= 0
    assert language.label([np.eye(200, dtype=np.float32)[[180] * 4] * 50], 2.0)[0].tolist() == [180] * 4
    train = [("zh", "今天天气很好我们去公园散步吧"), ("ja", "きょうはてんきがいいのでこうえんへいきます"), ("en", "the house and the garden with this and that")] * 20
    model = language.train(spark.createDataFrame(train, "lang string, text string"))
    ask = spark.createDataFrame([(1, "我们今天去公园很好的天气散步吧今天天气很好the house and the garden with this and that house and garden")], "doc_id long, text string")
    got = language.identify(ask, model).first()
    assert {s["lang"] for s in got["lang_spans"]} == {"zh", "en"}
    few = language.train(spark.createDataFrame(train, "lang string, text string"), ngrams=5)
    assert all((few["logp"][:, k] > few["logp"][:, k].min()).sum() <= 5 for k in range(3))


def test_redaction_keeps_columns(spark, odd_docs, no_docs):
    p = pii.init(np.random.default_rng(0))
    got = pii.redact(odd_docs, p)
    assert got.columns == odd_docs.columns and got.count() == 10 and got.where("text is null").count() == 1
    assert pii.redact(no_docs, p).count() == 0 and pii.find(no_docs, p).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 7):
        s = rng.normal(0, 6, (n, 3)).astype(np.float32)
        path = language.label([s, s[:2]], 4.0)[0]
        value = lambda q: sum(s[k, a] for k, a in enumerate(q)) - 4.0 * sum(a != b for a, b in zip(q, q[1:]))
        best = max((value(q) for q in np.ndindex(*(3,) * n)), default=0)
        assert abs(value(path) - best) < 1e-4


def test_language_on_mixed_and_odd_text(spark, odd_docs, no_docs):
    train = [("en", "the house and the garden with this and that"), ("fr", "la maison et le jardin avec cette rue"), ("ru", "дом и сад с этой улицей")] * 30
    model = language.train(spark.createDataFrame(train, "lang string, text string"))
    df = spark.createDataFrame([(1, "the garden and the house with that"), (2, "le jardin et la maison avec le jardin"), (3, "дом"), (4, "12 !"), (5, None), (6, "漢字"), (7, "the house and the garden with this and that le jardin et la maison avec cette rue et la maison")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, 5)] == ["en", "fr", "ru", "und", "und"]
    assert got[6]["lang_pred"] in model["langs"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {s["lang"] for s in got[7]["lang_spans"]} == {"en", "fr"}
    assert language.identify(odd_docs, model).count() == 10 and language.identify(no_docs, model).count() == 0
    nothing = language.learnt(no_docs)
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.op10_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_lm_base_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = lm.op4_lm_score(spark, sf).collect()
    c = Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    for r in got:
        w = [*(docs[r["doc_id"]] or "").encode().lower().split(), b""]
        base = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n) and abs(base - r["base_score"]) < 1e-6 * abs(base)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and np.isfinite(r["score"])
    held = [r for r in got if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.15  # log10 per token over the unigram base


def slow_score(text, c, lex, p):
    """One token after the other, with the whole distribution over the outputs written out."""
    words, total = [*text.encode().lower().split(), b""], 0.0
    before = [0] * lm.BACK
    for w in words:
        x = 0 if w == b"" else lex.place([w])[1][0]
        q = sum(p["r"][o] * p["c"][k] for k, o in enumerate(before)).astype(np.float64)
        ks = np.exp(p["T"] @ q + p["B"])
        dist = np.zeros(lex.size)
        for k, m in enumerate(lex.members):
            e = np.exp(p["t"][m] @ q + p["b"][m])
            dist[m] = ks[k] / ks.sum() * e / e.sum()
        assert abs(dist.sum() - 1) < 1e-6
        share = 1.0
        if x > lex.own:
            same = [y for y in c if y and lex.place([y])[1][0] == x]
            share = (c[w] + 0.5) / (sum(c[y] + 0.5 for y in same) + 0.5)
        total += np.log10(dist[x] * share)
        before = [x, *before[:-1]]
    return total


def test_lm_equals_a_slow_scorer(spark, odd_docs, no_docs, monkeypatch):
    texts = [f"the {a} of the {b} is {a}ing {b}ed rare{k}ing" for k in range(40) for a, b in [("cat", "dog"), ("sun", "sea"), ("mill", "hill")]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    monkeypatch.setattr(lm, "CLASS", 6)
    counts = lm.word_counts(docs).cache()
    c = Counter({r["word"].encode(): r["c"] for r in counts.collect()})
    lex = lm.Lexicon(counts, most=12, endings=4)
    p = lm.train(docs, lex)
    assert len(lex.members) > 1 and sorted(np.concatenate(lex.members)) == list(range(lex.size))
    ask = ["the cat of the sea is new", "", None, "rare7ing zzz the", texts[0], "Hello World again and again"]
    got = lm.score(spark.createDataFrame([(k, t) for k, t in enumerate(ask)], "doc_id long, text string"), counts, lex, p).collect()
    for r in got:
        want = slow_score(ask[r["doc_id"]] or "", c, lex, p)
        assert abs(r["score"] - want) < 1e-3 * abs(want), ask[r["doc_id"]]
    assert lm.score(odd_docs, counts, lex, p).count() == 10
    empty = lm.word_counts(no_docs)
    lex = lm.Lexicon(empty)
    assert lm.score(odd_docs, empty, lex, lm.train(no_docs, lex)).where("n_known = 0").count() == 10


def test_lm_classes_come_from_all_training_tokens(spark, monkeypatch):
    texts = [f"w{k % 13} v{k * k % 17} w{k * 7 % 11} end{k % 5}" for k in range(4600)]  # samples of 4,000 rows were read before
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "CLASS", 4)
    counts = lm.word_counts(docs).cache()
    lex, want = lm.Lexicon(counts), lm.Lexicon(counts)
    lm.learn_classes(lm.encoded(docs, lex), lex)
    heads = np.argsort(-want.freq, kind="stable")[: lm.PROFILE].tolist()
    x = np.zeros((want.size, lm.PROFILE))
    for t in texts:
        before = [0] * lm.BACK
        for o in [*want.place(t.encode().split())[1].tolist(), 0]:
            for b in before:
                x[o, heads.index(b)] += 1
            before = [o, *before[:-1]]
    seen, prior = [], x.sum(axis=0) / x.sum()
    monkeypatch.setattr(want, "group", seen.append)
    monkeypatch.setattr(lex, "group", seen.append)
    lm.learn_classes(lm.encoded(docs, lex), lex)
    assert np.allclose(seen[0], np.sqrt((x + 4 * prior) / (x.sum(axis=1, keepdims=True) + 4)), atol=1e-12)
    want.__class__.group(want, seen[0])
    assert (want.cls == lex.cls).all() and len(want.members) > 4


def test_decontamination_cases(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Hello world"), (3, None), (None, "again"), (4, "a, b")], "item_id long, text string")
    rows = [(10, "x One two THREE four five six seven eight nine ten z"), (11, "one two three four five six seven eight nine"), (12, "hello, world! hello world"), (13, None), (10, "clean")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_hit int")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == [(10, 1, 0, ()), (10, 12, 10, ("1",)), (11, 9, 0, ()), (12, 4, 4, ("2",)), (13, 0, 0, ())]
    big = sorted((r["doc_id"], r["n_hit"]) for r in decontaminate.decontaminate(docs, bench, broadcast_words=0).collect())
    assert big == [(10, 0), (10, 10), (11, 0), (12, 4), (13, 0)]
    assert decontaminate.decontaminate(odd_docs, bench).where("contaminated").count() == 3
    assert decontaminate.decontaminate(no_docs, bench).count() == 0 and decontaminate.decontaminate(odd_docs, bench.where("item_id < 0")).where("contaminated").count() == 0
    near = {(r["doc_id"], r["item_id"]) for r in decontaminate.proximity_hits(docs, bench, slop=2).collect()}
    assert (12, "2") in near and (10, "1") in near
