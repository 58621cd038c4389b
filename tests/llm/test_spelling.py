"""Spelling variants against brute force on small vocabularies."""

import random
import re
import zlib
from collections import Counter

from stratafold.llm import spelling


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, loses):
    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c < "\x80" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r if h % loses else r[: h % len(r)] + r[h % len(r) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    out = {}
    for w in n:
        near = [v for v in n if is_near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = (n[w], len(near), form, n[form] if form else None)
    return out


def check(spark, counts):
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    want = brute(counts)
    assert {w: (r.n, r.n_near, r.form, r.form_n) for w, r in got.items()} == want
    for w in want:
        root = w
        while want[root][2]:
            root = want[root][2]
        assert got[w].root == root


def test_random_edits(spark):
    rng, words = random.Random(5), set()
    letters = "abcdeéÿñ×"
    seeds = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(15)]
    for s in seeds:
        words.add(s)
        for _ in range(12):
            k, i = rng.randrange(3), rng.randrange(len(s))
            s = (s[:i] + s[i + 1 :]) if k == 0 and len(s) > 6 else s[:i] + rng.choice(letters) + s[i + (k == 1) :]
            words.add(s)
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdef", "fedcba", "abcdfe", "badcfe", "a" * 300, "a" * 301, "b" + "a" * 300}
    check(spark, {w: 5 ** rng.randint(1, 6) + rng.randint(0, 3) for w in sorted(words)})


def test_chain_of_forms_and_ties(spark):
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125}
    check(spark, chain | {"zzzzza": 50, "zzzzzb": 50, "zzzzzc": 10, "zzzzzd": 11})
    r = {x.word: x for x in spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert r["aaaaaa"].root == "bbbbbb" and r["bbbbbb"].form is None


def test_counts_and_odd_rows(spark, odd_docs, no_docs):
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
    rows = [(i, f"Spelling spelling ÉCOLES écoles Straße_straße{i} naïveté×y short no " * 3) for i in range(40)] + [(None, "spelling " * 5), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    for loses in (3, 199):
        assert dict(map(tuple, spelling.word_counts(docs, loses=loses).collect())) == brute_counts(rows, loses)
    assert spelling.variants(spelling.word_counts(odd_docs, least=1)).count() == len({w for r in odd_docs.collect() for w in re.findall("[a-zà-ÿ]{6,}", (r.text or "").lower())})
