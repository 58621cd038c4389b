"""Language identification against plain loops: counts, word scores, best paths and the label of each text."""

import itertools
import math
import random

import numpy as np

from stratafold.llm import language

TRAIN = {
    "en": "the house and the garden with this that they have",
    "de": "das haus und der garten mit diesem dass sie haben über",
    "fr": "la maison et le jardin avec ceci que elles ont très",
    "ru": "дом и сад с этим что они имеют очень",
}


def counted(rows):
    """Occurrences of each n-gram per language, and letters per script."""
    grams, scripts = {}, {}
    for lang, text in rows:
        for w in text.split():
            w = "".join(c for c in w.lower() if c.isalpha())
            if w:
                scripts.setdefault(language.script(w[0]), {}).setdefault(lang, 0)
                scripts[language.script(w[0])][lang] += len(w)
                for g in [f"^{w}$"[i : i + 3] for i in range(len(w))] + ["=" + w]:
                    grams.setdefault(g, {}).setdefault(lang, 0)
                    grams[g][lang] += 1
    return grams, scripts


def slow_scores(rows, text):
    grams, scripts = counted(rows)
    langs = sorted({lang for lang, _ in rows})
    total = {k: sum(g.get(k, 0) for g in grams.values()) for k in langs}
    share = {k: sum(s.get(k, 0) for s in scripts.values()) for k in langs}
    out, size = [], []
    for word in text.split():
        w = "".join(c for c in word.lower() if c.isalpha())
        size.append(len(w))
        if not w:
            out.append([0.0] * len(langs))
            continue
        found = [g for g in [f"^{w}$"[i : i + 3] for i in range(len(w))] + ["=" + w] if g in grams]
        s = [sum(math.log((grams[g].get(k, 0) + 0.5) / (total[k] + 1)) for g in found) for k in langs]
        top = max(s)
        s = [max((x - top) / max(len(found), 1) * min(len(w), language.MOST) / 2, 2 * language.FLOOR) for x in s]
        ok = [scripts.get(language.script(w[0]), {}).get(k, 0) / max(share[k], 1) >= 0.001 for k in langs]
        if any(ok) and not all(ok):
            s = [x if o else 4 * language.FLOOR for x, o in zip(s, ok, strict=True)]
        out.append(s)
    return langs, np.array(out).reshape(len(size), len(langs)), size


def test_labels_equal_loops(spark):
    rng = random.Random(1)
    rows = [(lang, " ".join(rng.choice(t.split()) for _ in range(12))) for lang, t in TRAIN.items() for _ in range(15)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    texts = ["", "12 !!", "the дом und", "the House, and; the GARDEN"]
    for _ in range(60):
        pieces = [" ".join(rng.choice(TRAIN[k].split()) + rng.choice(["", "", ",", "x", "9"]) for _ in range(rng.randint(1, 3))) for k in rng.choices(list(TRAIN), k=rng.randint(1, 2))]
        texts.append(" ".join(pieces))
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    speller = language.Speller(model)
    for r in got:
        langs, s, size = slow_scores(rows, r.text)
        assert np.abs(speller.matrices([language.words(r.text)])[0][0] - s).max(initial=0) < 1e-4
        if not sum(size):
            assert (r.lang_pred, r.score, r.lang_spans) == ("und", 0.0, [])
            continue
        value = lambda p: sum(s[k, a] for k, a in enumerate(p)) - language.SWITCH * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        path = [k for x in r.lang_spans for k in [langs.index(x["lang"])] * (x["end"] - x["start"])]
        assert len(path) == len(size)
        assert value(path) >= max(value(p) for p in itertools.product(range(len(langs)), repeat=len(size))) - 1e-3
        held = [sum(n for n, a in zip(size, path, strict=True) if a == k) for k in range(len(langs))]
        assert r.lang_pred == langs[held.index(max(held))] and abs(r.score - max(held) / sum(held)) < 1e-12
