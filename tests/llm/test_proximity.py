"""Proximity matches against a scan of every document for every window."""

import random
import re
from collections import Counter

import pytest

from stratafold.llm import decontaminate


def words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def scan(docs, items, window, slop):
    n, reach, out = Counter(w for _, t in docs for w in words(t)), window + slop, set()
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            win = w[s : s + window]
            if any(not n[x] for x in win):
                continue
            rare = win[min(range(len(win)), key=lambda k: (n[win[k]], k))]  # noqa: B023
            for d, t in docs:
                v = words(t)
                for p, x in enumerate(v):
                    if x == rare and all(any(v[q] == y for q in range(max(0, p - reach + 1), min(len(v), p + reach))) for y in win):
                        out.add((d, str(item), p))
    return sorted(out)


@pytest.mark.parametrize("window,slop,broadcast", [(4, 2, 200_000), (3, 0, 200_000), (4, 3, 5)])
def test_proximity_equals_scan(spark, window, slop, broadcast):
    rng = random.Random(window * 10 + slop)
    text = lambda k: " ".join(rng.choice("abcdefghijklmnop"[: rng.choice([6, 16])]) for _ in range(k))
    docs = [(k, text(rng.randint(0, 60))) for k in range(25)] + [(100, None), (101, "")]
    items = [(k, text(rng.choice([1, 2, 3, 4, 7]))) for k in range(12)] + [(50, "zzz a b"), (51, ""), (52, None)]
    items.append((53, " ".join(words(docs[3][1])[5:12])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.pos) for r in decontaminate.proximity_hits(d, b, window, slop, broadcast).collect())
    want = scan(docs, items, window, slop)
    assert got == want and len(want) > 50
