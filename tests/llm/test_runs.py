"""Periodic runs against a scan over all periods."""

import random

import pytest

from stratafold.llm import runs


def brute(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, 2 * q):
                cut = w[s : s + n]
                if not any(cut[d:] == cut[: n - d] for d in range(1, q)):
                    out.append((s, n, q))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def text(rng):
    letters, size, w = rng.choice([1, 2, 3, 5, 50]), rng.randint(0, 120), []
    while len(w) < size:
        if w and rng.random() < 0.4:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 20)] * rng.randint(1, 4)
        else:
            w.append(rng.randrange(letters))
    return w


@pytest.mark.parametrize("least", [2, 12])
def test_equals_brute_force(least):
    rng = random.Random(least)
    for _ in range(400):
        texts = [text(rng) for _ in range(rng.randint(1, 4))]
        assert runs.runs_of(texts, least) == [brute(w, least) for w in texts]


@pytest.mark.parametrize("length", [1, 2, 6])
def test_smaller_half_alone(length):
    """The refinement from factors of `length` on, without the array form of the first lengths."""
    rng = random.Random(length)
    for _ in range(200):
        w = text(rng)
        seen = {}
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i : i + length]), []).append(i)
        cls = [-1] * len(w)
        for k, g in enumerate(seen.values()):
            for i in g if len(g) > 1 else ():
                cls[i] = k
        assert sorted(runs.long_periods(cls, length, 1)) == sorted(r for r in brute(w, 1) if r[2] >= length)


def test_long_periodic_and_fibonacci_texts():
    a, b = [0], [0, 1]
    while len(b) < 4000:
        a, b = b, b + a
    assert runs.runs_of([b[:600]], 2) == [brute(b[:600], 2)]
    assert len(runs.runs_of([b], 12)[0]) > 100
    assert runs.runs_of([["w"] * 50_000, [1, 2, 3] * 20_000]) == [[(0, 50_000, 1)], [(0, 60_000, 3)]]
    assert (0, 40_000, 10_000) in runs.runs_of([list(range(10_000)) * 4])[0]


def test_collapsed():
    w = list("abcabcabcabcabcxy")
    assert runs.runs_of([w]) == [[(0, 15, 3)]]
    assert runs.collapsed(w, [(0, 15, 3)]) == list("abcxy")
    assert runs.collapsed(w, []) == w


def test_looped_repeats_a_tail():
    ids = [i for i in range(300) if runs.looped(i, list(range(100))) != list(range(100))]
    assert 15 < len(ids) < 50
    for i in ids:
        w = runs.looped(i, list(range(100)))
        assert len(w) == 100 and w != list(range(100))
    assert runs.looped(None, [1, 2]) == [1, 2] and all(runs.looped(i, []) == [] for i in range(50))


def test_odd_rows(spark, odd_docs, no_docs):
    assert runs.periodic_runs(no_docs, loops=True).count() == 0
    rows = runs.periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.collapsed is not None for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].runs == [] and by[1].collapsed == "" and by[3].collapsed == ""
    assert [tuple(x) for x in by[5].runs] == [(0, 9000, 3)] and by[5].collapsed == "abc déf 12"
    assert by[None].collapsed == "orphan text here"
