"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Learning. A classifier is fitted on about `TRAIN_ROWS` training rows (lang and text not null; all of them if there are
fewer), chosen by a hash of their ids: words and padded character trigrams are counted per language, map-side combined,
and the model keeps the most frequent n-grams of each language, at most 4 * `NGRAMS`.

Prediction. A word's script (of its first letter) selects the languages in which that script has a share of letters;
among these a word scores by its n-grams' log probabilities (bounded per word). Viterbi over the words, with a constant
penalty for a switch, labels each word; runs of equal labels are the spans. (A text is one span at once if no run of
words gains more over its best single language than the switches it takes: two inside the text, one at an end.) Words are
what stands between white space; in scripts written without spaces, runs of `CHUNK` characters. The document's language has most letters,
ties go to the smaller name; score is its share of the letters, 0 to 1. Documents of a batch are decoded together.

Defined cases. Null text, or text without a letter: `und`, score 0, no spans. Scripts that no language has are scored
over all languages. Without training rows everything is `und`. Repeated rows get a row each. lang, source and doc_id are
never inputs of a prediction.
"""

from __future__ import annotations

import bisect
import itertools
import pickle
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

UND = "und"
#: Kept n-grams per language at most; a bound on the broadcast model.
NGRAMS = 60_000
#: Labelled rows that the classifier is fitted on, about.
TRAIN_ROWS = 10_000
SWITCH, FLOOR, MOST = 12.0, -4.0, 12
#: Characters of scripts written without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
CHUNK = 4
PARTS = re.compile(f"{UNSPACED.pattern}{{1,{CHUNK}}}|{UNSPACED.pattern.replace('[', '[^')}+")
CACHE = 300_000
#: First code points of script ranges, and their scripts.
SCRIPT_STARTS = [0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0]
SCRIPT_NAMES = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "indic", "thai", "lao", "georgian", "hangul", "ethiopic", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other"]


def script(c: str) -> str:
    return SCRIPT_NAMES[bisect.bisect_right(SCRIPT_STARTS, ord(c)) - 1]


def words(text: str) -> list[str]:
    out = text.split()
    if UNSPACED.search(text):
        out = [p for w in out for p in (PARTS.findall(w) if UNSPACED.search(w) else (w,))]
    return out


def letters(word: str) -> str:
    """The lower-cased letters of a word."""
    w = word.lower()
    return w if w.isalpha() else "".join([c for c in w if c.isalpha()])


def grams(w: str) -> list[str]:
    """Padded character trigrams, and the word itself."""
    p = f"^{w}$"
    return [p[i : i + 3] for i in range(len(w))] + [f"={w}"]


class Places(dict):
    """N-gram to its row; any other n-gram to the row of zeros, `absent`."""

    def __init__(self, rows=(), absent: int = 0):
        super().__init__(rows)
        self.absent = absent

    def __missing__(self, gram: str) -> int:
        return self.absent


def train(labelled: DataFrame, ngrams: int = NGRAMS) -> dict:
    """`labelled` (lang, text) to a model: languages, log probabilities per n-gram, candidates per script."""
    import pyarrow as pa

    def count(batches):
        total: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                total.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, total.values())) > CACHE:
                yield from emit(total)
                total = {}
        yield from emit(total)

    def emit(total):
        for lang, counted in total.items():
            plain = Counter()
            for w, n in counted.items():
                plain[letters(w)] += n
            plain.pop("", None)
            out, scripts = Counter(), Counter()
            for w, n in plain.items():
                scripts[script(w[0])] += n * len(w)
                for g in grams(w):
                    out[g] += n
            for s, n in scripts.items():
                out[f"#{s}"] = n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array(list(out)), pa.array(list(out.values()), pa.int64())], ["lang", "gram", "n"])

    counts = labelled.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    level, least, total = F.floor(F.log2("n") * 8).cast("int"), {}, Counter()
    for r in sorted(counts.groupBy("lang", level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # some hundred rows a language
        if total[r["lang"]] + r["count"] > ngrams:
            total[r["lang"]] = ngrams  # no lower level of this language
        else:
            total[r["lang"]] += r["count"]
            least[r["lang"]] = r["level"]
    floor = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.lit(None).cast("map<string,int>")
    top = counts.where((level >= floor[F.col("lang")]) | F.col("gram").startswith("#")).collect()  # at most ngrams a language, and its scripts
    langs = sorted({r["lang"] for r in top})
    at = {lang: k for k, lang in enumerate(langs)}
    table_: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for r in top:
        into = scripts if r["gram"][0] == "#" else table_
        into.setdefault(r["gram"].lstrip("#") if into is scripts else r["gram"], np.zeros(len(langs)))[at[r["lang"]]] = r["n"]
    rows = np.array(list(table_.values())).reshape(len(table_), len(langs))
    total = rows.sum(axis=0)
    share = sum(scripts.values(), np.zeros(len(langs)))
    return {
        "langs": langs,
        "grams": Places({g: k for k, g in enumerate(table_)}, len(table_)),
        "logp": np.log((rows + 0.5) / (total + 1.0)).astype(np.float32),
        "scripts": {s: (c / np.maximum(share, 1)) >= 0.001 for s, c in scripts.items()},
    }


class Speller:
    """Words to rows of a score matrix (one column per language), each scored once while a bounded table keeps it."""

    def __init__(self, model: dict):
        self.m = model
        have = model["logp"]
        self.find = model["grams"].__getitem__
        self.logp = np.zeros((len(have) + 1, len(model["langs"]) + 1), np.float32)  # the last row is that of absent n-grams
        self.logp[:-1, :-1], self.logp[:-1, -1] = have, 1
        self.narrow = {s: ok for s, ok in model["scripts"].items() if ok.any() and not ok.all()}  # scripts of some languages only
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.m["langs"])), np.float32)
        self.size = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        plain = [letters(w) for w in words]
        at = [list(map(self.find, grams(w))) if w else [] for w in plain]
        size = np.array([len(w) for w in plain], np.int64)
        ends = np.cumsum([len(x) for x in at])
        flat = np.fromiter(itertools.chain.from_iterable(at), np.int64, int(ends[-1]))
        sums = np.vstack([np.zeros((1, self.logp.shape[1])), np.cumsum(self.logp[flat], axis=0, dtype=np.float64)])
        s = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        n, s = s[:, -1], s[:, :-1]  # the last column counts the n-grams that the model has
        s = s - s.max(axis=1, keepdims=True)
        # trigrams overlap, so a letter counts about once; a word's say is bounded
        s = np.maximum(s / np.maximum(n, 1)[:, None] * np.minimum(size, MOST)[:, None] / 2, 2 * FLOOR)
        if self.narrow:
            for k, w in enumerate(plain):
                ok = self.narrow.get(script(w[0])) if w else None
                if ok is not None:
                    s[k] = np.where(ok, s[k], 4 * FLOOR)
        s[size == 0] = 0
        self.row.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.scores = np.vstack([self.scores, s.astype(np.float32)])
        self.size = np.concatenate([self.size, size])

    def matrices(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the scores and letter counts of its words."""
        if len(self.row) > CACHE:
            self.reset()
        new = list({w for t in texts for w in t if w not in self.row})
        if new:
            self.learn(new)
        out = []
        for t in texts:
            at = np.fromiter(map(self.row.__getitem__, t), np.int64, len(t))
            out.append((self.scores[at], self.size[at]))
        return out


def label(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Viterbi labels of each document's words; documents of which one language is the whole best path need no search."""
    out, search = [], []
    for k, s in enumerate(scores):
        best = int(s.sum(axis=0).argmax()) if len(s) else 0
        out.append(np.full(len(s), best, np.int16))
        if s.shape[1] > 1 and len(s):
            rest = np.delete(s, best, axis=1).max(axis=1) - s[:, best]
            run = np.concatenate([[0], np.cumsum(rest, dtype=np.float64)])
            low = np.minimum.accumulate(run)
            # the most that a stretch inside, one from the front and one to the end can gain over staying
            if (run - low).max() > 2 * switch or run.max() > switch or run[-1] - low[-1] > switch:
                search.append(k)
    for k, path in zip(search, viterbi([scores[k] for k in search], switch), strict=True):
        out[k] = path
    return out


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Labels per word for each document; all documents advance together, longest first."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lens = np.array([len(scores[k]) for k in order])
    if not len(lens) or not lens[0]:
        return [np.zeros(len(s), np.int16) for s in scores]
    n_lang = scores[order[0]].shape[1]
    steps = int(lens[0])
    alive = np.searchsorted(-lens, -np.arange(1, steps + 1), side="right")  # documents with more than t words
    ends = np.concatenate([[0], np.cumsum(lens)])
    flat = np.concatenate([scores[k] for k in order])
    back = [None] * steps
    v = np.zeros((len(lens), n_lang), np.float32)
    for t in range(steps):
        a = alive[t]
        if t:
            best = v[:a].argmax(axis=1)
            jump = v[np.arange(a), best] - switch
            stay = v[:a] >= jump[:, None]
            back[t] = np.where(stay, np.arange(n_lang, dtype=np.int16), best[:, None].astype(np.int16))
            v[:a] = np.where(stay, v[:a], jump[:, None])
        v[:a] += flat[ends[:a] + t]
    last = v.argmax(axis=1)
    path = np.zeros(len(flat), np.int16)
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        path[ends[:a] + t] = last[:a]
        if t:
            last[:a] = back[t][np.arange(a), last[:a]]
    out: list = [None] * len(scores)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[order[k]] = path[a:b]
    return out


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of `docs` (any columns, text among them): its columns, lang_pred, score and
    lang_spans ARRAY<STRUCT<start, end, lang>> in words between white space."""
    import pyarrow as pa

    langs = model["langs"]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(pickle.dumps(model))  # at most NGRAMS n-grams per language; workers keep the bytes, tasks the model
    base = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "lang_spans")])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        speller = Speller(pickle.loads(shared.value))  # noqa: S301
        for b in batches:
            texts = [words(t or "") for t in b.column("text").to_pylist()]
            mats = speller.matrices(texts) if langs else [(np.zeros((0, 1)), np.zeros(0)) for _ in texts]
            pred, score, marked = [], [], []
            for (_, n), path in zip(mats, label([m for m, _ in mats]), strict=True):
                if not n.sum():
                    pred.append(UND)
                    score.append(0.0)
                    marked.append([])
                    continue
                share = np.bincount(path, weights=n, minlength=len(langs))
                k = int(share.argmax())
                pred.append(langs[k])
                score.append(float(share[k] / share.sum()))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                marked.append([{"start": a, "end": e, "lang": langs[path[a]]} for a, e in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(marked, spans)], [*b.schema.names, "lang_pred", "score", "lang_spans"]
            )

    from pyspark.sql.types import StructType

    schema = StructType.fromJson(base.schema.jsonValue()).add("lang_pred", "string").add("score", "double")
    from pyspark.sql.types import ArrayType, IntegerType, StringType

    item = StructType().add("start", IntegerType()).add("end", IntegerType()).add("lang", StringType())
    return base.mapInArrow(run, schema.add("lang_spans", ArrayType(item)))


def fold(doc_id="doc_id", n: int = 4):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def learnt(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The model of about `rows` rows of the training fold: crc32(doc_id) mod 4 is not 2, lang and text not null."""
    fit = docs.where("lang is not null and text is not null and doc_id is not null").where(fold() != 2)
    keep = rows / max(1, fit.count())
    return train(fit.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(keep * (1 << 30))) if keep < 1 else fit)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learnt(docs.select("doc_id", "lang", "text")))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
