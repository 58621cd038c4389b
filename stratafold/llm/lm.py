"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation in numpy.

Counts. The words of all training documents are counted (map-side combined, then by word). The `FREQUENT` most frequent
ones are broadcast; all other words of a document reach their counts by a join, so the vocabulary has no bound.
Model. Outputs are the end of a text, the `WORDS` most frequent words, and for all other words the `ENDINGS` heaviest
two-byte endings and one output for the rest; below an ending a word has probability (c + 1/2) / (sum of the ending's
words + 1/2), the last half for any unseen word, so the distribution over all words is normalised. The net predicts from
the `BACK` outputs before: q = sum of r[output] * c[place], then a class by q.T + B and an output of the class by
q.t + b. The classes are learnt: outputs are described by the frequent outputs that precede them in all training tokens and
halved along the principal direction until a class holds about `CLASS` of them.
Codes. Texts are read once for the counts and once to be written as outputs, two bytes a token; classes, training and
scores read these.
Training. Each partition trains a copy of the model on all its training tokens by noise-contrastive estimation, once for
the classes and once for the outputs (noise: their frequencies). Copies are averaged, weighted by tokens: first those of
about a `1 / WARM` part of the documents, then, from that average, those of all.
Normalisation. A batch's contexts times all classes, and times the members of each class that occurs, are matrix
products; every token's log-probability is normalised by both.

Defined cases. Null text is empty: one token, the end. Null doc_id counts as a training document. Repeated rows get a row
each and train each time. Without training tokens every probability is the uniform one of the formulas. Batches shorter
than `BATCH` are trained as they are. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent, materialise, table

WORDS, ENDINGS, FREQUENT = 8192, 255, 131_072
#: Words longer than this (bytes) are never broadcast.
WORD_BYTES = 64
DIM, BACK, CLASS, BATCH, RATE = 16, 3, 96, 1024, 0.15
CLASS_NOISE, WORD_NOISE, WARM = 64, 64, 8
#: The classes are learnt from so many preceding outputs, the most frequent ones.
PROFILE = 256
#: Distinct words that a counting task holds at once.
HELD = 300_000
SEED = 11
END = ""  # no word is empty


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (END for the ends of texts), c over all rows of `docs` (text)."""
    import pyarrow as pa

    def emit(c):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

    def run(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                c.update(tokens(t))
            c[b""] += b.num_rows
            if len(c) > HELD:
                yield emit(c)
                c = Counter()
        if c:
            yield emit(c)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def ending_col(word):
    return F.substring(word.cast("binary"), -2, 2)


class Places(dict):
    """Word to its index among the frequent ones; any other word to minus its ending's number."""

    def __missing__(self, word: bytes) -> int:
        return -self.endings.get(word[-2:], self.rest)


class Lexicon:
    """The broadcast part of the vocabulary: output and log10(c + 1/2) of each frequent word, the endings of the others,
    the outputs' frequencies and classes."""

    def __init__(self, counts: DataFrame, most: int = WORDS, endings: int = ENDINGS):
        row = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = row["n"] or 0, row["v"]
        ends = counts.where(F.col("word") == END).first()
        words = counts.where(F.col("word") != END)
        top = frequent(words.where(F.octet_length("word") <= WORD_BYTES), FREQUENT)
        self.end_count = ends["c"] if ends else 0
        self.at = Places((r["word"].encode(), k) for k, r in enumerate(top))
        c = np.array([r["c"] for r in top], np.float64)
        self.log_c = np.log10(c + 0.5)
        self.own = min(len(top), most)  # outputs 1 to own are words
        mass: dict[bytes, float] = {}
        for r in words.groupBy(ending_col(F.col("word")).alias("e")).agg(F.sum(F.col("c") + F.lit(0.5)).alias("m")).collect():
            mass[bytes(r["e"])] = r["m"]  # at most 256 + 256 * 256 endings
        for w, k in self.at.items():
            if k < self.own:
                mass[w[-2:]] -= c[k] + 0.5
        mass = {e: m for e, m in mass.items() if m > 0.25}
        kept = sorted(mass, key=lambda e: (-mass[e], e))[:endings]
        self.at.endings, self.at.rest = {e: 1 + k for k, e in enumerate(kept)}, 1 + len(kept)
        tail = np.array([mass[e] for e in kept] + [sum(m for e, m in mass.items() if e not in self.at.endings)]) + 0.5
        self.log_mass = np.log10(tail)
        self.size = 1 + self.own + len(tail)
        out = [1 + k if k < self.own else self.own - self.at.__missing__(r["word"].encode()) for k, r in enumerate(top)]
        self.out = np.array([*out, *range(self.own + len(tail), self.own, -1)], np.int64)  # minus e finds the ending e
        self.freq = np.concatenate([[self.end_count + 0.5], c[: self.own] + 0.5, tail])
        self.group(np.zeros((self.size, 1)))

    def group(self, profile: np.ndarray) -> None:
        """Classes of outputs: halved along the principal direction of their profiles down to about `CLASS` members."""
        order = []
        queue = [np.arange(self.size)]
        while queue:
            rows = queue.pop()
            if len(rows) <= CLASS:
                order.append(rows)
                continue
            x = profile[rows] - profile[rows].mean(axis=0)
            d = np.linalg.eigh(x.T @ x)[1][:, -1]
            by = rows[np.lexsort((rows, x @ d))]
            queue += [by[len(by) // 2 :], by[: len(by) // 2]]
        self.members = order
        self.cls, self.slot = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        for k, rows in enumerate(order):
            self.cls[rows], self.slot[rows] = k, np.arange(len(rows))
        p = self.freq / self.freq.sum()
        self.p_class = np.bincount(self.cls, p, len(order))
        self.p_word = p / self.p_class[self.cls]

    def code(self) -> type:
        """The type in which outputs are written."""
        return np.uint16 if self.size <= 1 << 16 else np.uint32

    def place(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index among the frequent words (negative: none) and output of each word."""
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return at, self.out[at]


def initial(lex: Lexicon) -> dict[str, np.ndarray]:
    """Small random vectors; biases such that the untrained model is the outputs' frequencies."""
    rng = np.random.default_rng(SEED)
    f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    c = np.ones((BACK, DIM), np.float32) / np.arange(1, BACK + 1, dtype=np.float32)[:, None]
    return {"r": f(lex.size, DIM), "c": c, "T": f(len(lex.members), DIM), "B": np.log(lex.p_class).astype(np.float32), "t": f(lex.size, DIM), "b": np.log(lex.p_word).astype(np.float32)}


def pack(p) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def unpack(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    p, at = {}, 0
    for k in sorted(like):
        p[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return p


def summed(idx: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices and the sums of their gradients."""
    order = np.argsort(idx.astype(np.uint16) if idx.max() < 1 << 16 else idx, kind="stable")  # a radix sort if it fits
    s = idx[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.add.reduceat(np.take(grad, order, axis=0), first, axis=0)


class Trainer:
    """Noise-contrastive estimation with AdaGrad on the touched rows; a batch shares its noise. Biases stay the
    logarithms of the outputs' frequencies, which also are the noise, so a score less its noise is q.t alone."""

    def __init__(self, lex: Lexicon, params: dict[str, np.ndarray], seed: int = SEED):
        self.lex, self.p = lex, {k: a.copy() for k, a in params.items()}
        self.g = {k: np.ones(a.shape, np.float32) for k, a in self.p.items() if k in "rcTt"}
        self.class_cum, self.word_cum = np.cumsum(lex.p_class), np.cumsum(lex.freq / lex.freq.sum())
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def move(self, name: str, idx, grad: np.ndarray) -> None:
        g = self.g[name][idx] if isinstance(idx, slice) else np.take(self.g[name], idx, axis=0)  # faster than an index
        g += grad * grad
        self.g[name][idx] = g
        grad *= RATE
        grad /= np.sqrt(g, out=g)
        self.p[name][idx] -= grad

    def contrast(self, name: str, q1: np.ndarray, at: np.ndarray, cum: np.ndarray, noise: int) -> np.ndarray:
        """One estimation: data `at` against `noise` draws shared by the batch; moves the table, returns the gradient by
        q, which `q1` has with ones in a last column."""
        t, q = self.p[name], q1[:, :-1]
        z = np.minimum(np.searchsorted(cum, self.rng.random(noise)), len(cum) - 1)
        ta, tz = np.take(t, at, axis=0), t[z]
        e = -1 / (1 + np.exp(np.einsum("nd,nd->n", q, ta) - np.float32(np.log(noise))))
        x = q1 @ np.column_stack([-tz, np.full(noise, np.log(noise), np.float32)]).T
        np.exp(x, out=x)
        x += 1
        np.reciprocal(x, out=x)
        dq = e[:, None] * ta
        dq += x @ tz
        rows, grad = summed(np.concatenate([at, z]), np.concatenate([e[:, None] * q, x.T @ q]))
        self.move(name, rows, grad)
        return dq

    def step(self, ctx: np.ndarray, w: np.ndarray) -> None:
        """`ctx` (n, BACK): the outputs before, nearest first; `w` (n): the output that follows."""
        p, n = self.p, len(w)
        self.seen += n
        r = np.take(p["r"], ctx, axis=0)
        q = np.ones((n, DIM + 1), np.float32)
        np.einsum("nkd,kd->nd", r, p["c"], out=q[:, :DIM])
        with np.errstate(over="ignore"):  # a score beyond exp's range has the gradient zero or one, as it should
            dq = self.contrast("T", q, self.lex.cls[w], self.class_cum, CLASS_NOISE)
            dq += self.contrast("t", q, w, self.word_cum, WORD_NOISE)
        self.move("c", slice(None), np.einsum("nd,nkd->kd", dq, r) / n)
        self.move("r", *summed(ctx.reshape(-1), (dq[:, None, :] * p["c"]).reshape(-1, DIM)))


def contexts(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs before each token of a text, nearest first, and the tokens' outputs; before a text stand ends."""
    full = np.concatenate([np.zeros(BACK, np.int64), out, [0]])
    n = len(out) + 1
    return np.stack([full[BACK - 1 - k : BACK - 1 - k + n] for k in range(BACK)], axis=1), full[BACK:]


#: Parameters of a chunk, the unit in which copies are averaged.
CHUNK = 1 << 12


def by_chunk(df: DataFrame, dtype, weighted: bool = False) -> np.ndarray:
    """Sums of the chunks `v` (k, v, n), or their means weighted by n, in order of k; empty without rows."""
    import pyarrow as pa

    def run(batches):
        total: dict[int, np.ndarray] = {}
        seen: Counter = Counter()
        for b in batches:
            for k, v, n in zip(*(b.column(c).to_pylist() for c in ("k", "v", "n")), strict=True):
                x = np.frombuffer(v, dtype)
                x = x.astype(np.float64) * n if weighted else x
                total[k] = total[k] + x if k in total else x
                seen[k] += n
        ks = sorted(total)
        out = [(total[k] / seen[k] if weighted else total[k]).astype(dtype).tobytes() for k in ks]
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(out, pa.binary())], ["k", "v"])

    got = sorted(df.repartition("k").mapInArrow(run, "k int, v binary").collect())  # of one size, whatever the input
    return np.frombuffer(b"".join(bytes(r["v"]) for r in got), dtype)


def chunks(v: np.ndarray, n: int):
    """`v` in chunks as Arrow batches (k, v, n)."""
    import pyarrow as pa

    for k, lo in enumerate(range(0, len(v), CHUNK)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v[lo : lo + CHUNK].tobytes()], pa.binary()), pa.array([n], pa.int64())], ["k", "v", "n"])


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row of `docs` (doc_id, text), kept in the shared folder: row (a number), doc_id, warm (whether the text belongs
    to the first part of the training), out (its outputs), n_tokens, n_known and the sums that need no model; words and
    times: those that are not broadcast."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = shared.value
        end = np.log10(lex.end_count + 0.5)
        for b in batches:
            rows: list = [[] for _ in range(7)]
            for t in b.column("text").to_pylist():
                words = tokens(t)
                at, out = lex.place(words)
                known = at >= 0
                rare = Counter([words[k] for k in np.flatnonzero(~known)])
                fill = out > lex.own  # words that share an output
                log_c = lex.log_c[at[known]].sum() if len(lex.log_c) else 0.0
                inside = (lex.log_c[at[known & fill]].sum() if len(lex.log_c) else 0.0) - lex.log_mass[out[fill] - 1 - lex.own].sum()
                for col, x in zip(rows, (out.astype(lex.code()).tobytes(), len(words) + 1, int(known.sum()) + (lex.end_count > 0), log_c + end, inside, [r.decode() for r in rare], list(rare.values())), strict=True):
                    col.append(x)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("warm"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))],
                ["doc_id", "warm", "out", "n_tokens", "n_known", "log_c", "inside", "words", "times"],
            )

    base = docs.select("doc_id", "text", (F.pmod(F.xxhash64("text"), F.lit(WARM)) == 0).alias("warm"))
    kind = base.schema["doc_id"].dataType.simpleString()
    done = base.mapInArrow(run, f"doc_id {kind}, warm boolean, out binary, n_tokens long, n_known long, log_c double, inside double, words array<string>, times array<long>")
    return materialise(done.withColumn("row", F.monotonically_increasing_id()))


def read(batch, lex: Lexicon) -> list[tuple[np.ndarray, np.ndarray]]:
    """Contexts and outputs of each text of a batch of `encoded` rows."""
    return [contexts(np.frombuffer(v, lex.code()).astype(np.int64)) for v in batch.column("out").to_pylist()]


def learn_classes(codes: DataFrame, lex: Lexicon) -> None:
    """Groups the outputs by what precedes them in all `encoded` rows: a task counts pairs of an output and a head in one
    array of size x PROFILE, the arrays are summed by chunks."""
    heads = np.full(lex.size, PROFILE, np.int64)
    first = np.argsort(-lex.freq, kind="stable")[:PROFILE]
    heads[first] = np.arange(len(first))
    known = codes.sparkSession.sparkContext.broadcast((lex, heads))

    def run(batches):
        lex, heads = known.value
        total = np.zeros(lex.size * PROFILE, np.int64)

        def add(held):
            ctx, w = (np.concatenate([h[k] for h in held]) for k in range(2))
            h = heads[ctx]
            total[:] += np.bincount((w[:, None] * PROFILE + h)[h < PROFILE], minlength=len(total))

        held, n = [], 0
        for b in batches:
            for got in read(b, lex):
                held.append(got)
                n += len(got[1])
                if n >= 8 * TOKENS:
                    add(held)
                    held, n = [], 0
        if held:
            add(held)
        if total.any():
            yield from chunks(total, 1)

    x = by_chunk(codes.select("out").mapInArrow(run, "k int, v binary, n long"), np.int64).astype(np.float64)
    x = (x if len(x) else np.zeros(lex.size * PROFILE)).reshape(lex.size, PROFILE)
    prior = x.sum(axis=0) / max(x.sum(), 1)
    x = np.sqrt((x + 4 * prior) / (x.sum(axis=1, keepdims=True) + 4))  # rows shrunk to the average, Hellinger scale
    lex.group(x)


def averaged(codes: DataFrame, lex: Lexicon, params: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """`params` trained further on all `encoded` rows, one copy per partition, averaged by tokens."""
    known = codes.sparkSession.sparkContext.broadcast((lex, params))

    def run(batches):
        lex, params = known.value
        trainer, held, n = Trainer(lex, params), [], 0
        for b in batches:
            for got in read(b, lex):
                held.append(got)
                n += len(got[1])
                if n >= BATCH:
                    ctx, w = (np.concatenate([h[k] for h in held]) for k in range(2))
                    whole = n - n % BATCH
                    for lo in range(0, whole, BATCH):
                        trainer.step(ctx[lo : lo + BATCH], w[lo : lo + BATCH])
                    held, n = [(ctx[whole:], w[whole:])], n - whole
        if n:
            trainer.step(*(np.concatenate([h[k] for h in held]) for k in range(2)))
        if trainer.seen:
            yield from chunks(pack(trainer.p), trainer.seen)

    got = by_chunk(materialise(codes.select("out").mapInArrow(run, "k int, v binary, n long")), np.float32, weighted=True)
    return unpack(got, params) if len(got) else params


def fit(codes: DataFrame, lex: Lexicon) -> dict[str, np.ndarray]:
    """Classes of `lex` and averaged parameters over all `encoded` rows."""
    learn_classes(codes, lex)
    return averaged(codes, lex, averaged(codes.where("warm"), lex, initial(lex)))


def train(docs: DataFrame, lex: Lexicon) -> dict[str, np.ndarray]:
    """Classes of `lex` and averaged parameters over all rows of `docs` (doc_id, text)."""
    return fit(encoded(docs, lex), lex)


def log_share(q: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of q1 @ table.T at the columns `at`; the last column of `q` is one, that of `table` the bias."""
    out = np.empty(len(q), np.float32)
    norm = lambda v: np.sqrt(np.einsum("nd,nd->n", v[:, :-1], v[:, :-1]).max(initial=0.0))
    safe = norm(q) * norm(table) + np.abs(table[:, -1]).max(initial=0.0) < 60  # then no row can over- or underflow
    for lo in range(0, len(q), ROWS):
        x = q[lo : lo + ROWS] @ table.T
        pick = x[np.arange(len(x)), at[lo : lo + ROWS]]
        top = np.float32(0) if safe else x.max(axis=1)
        if not safe:
            x -= top[:, None]
        np.exp(x, out=x)
        out[lo : lo + ROWS] = pick - top - np.log(x @ np.ones(x.shape[1], np.float32))
    return out


def log_prob(lex: Lexicon, p: dict[str, np.ndarray], ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Natural log-probability of each output `w` after `ctx`."""
    q = np.ones((len(w), DIM + 1), np.float32)
    np.einsum("nkd,kd->nd", np.take(p["r"], ctx, axis=0), p["c"], out=q[:, :DIM])
    cls = lex.cls[w]
    out = log_share(q, np.column_stack([p["T"], p["B"]]), cls)
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    q, slot, t = np.take(q, order, axis=0), lex.slot[w[order]], np.column_stack([p["t"], p["b"]])
    ends = np.cumsum(np.bincount(cls, minlength=len(lex.members)))
    inside = np.empty(len(w), np.float32)
    for m, lo, hi in zip(lex.members, [0, *ends[:-1]], ends, strict=True):
        if hi > lo:
            inside[lo:hi] = log_share(q[lo:hi], t[m], slot[lo:hi])
    out[order] += inside
    return out


#: Rows of a matrix product, few enough for the cache.
ROWS = 2048
#: Tokens scored by one set of matrix products.
TOKENS = 1 << 16


def scored(codes: DataFrame, counts: DataFrame, lexicon: Lexicon, params: dict[str, np.ndarray]) -> DataFrame:
    """Per `encoded` row: doc_id, n_tokens, n_known, base_score, score (log10)."""
    import pyarrow as pa

    shared = codes.sparkSession.sparkContext.broadcast((lexicon, params))

    def nets(held):
        """log10-probability of each text's outputs; texts share matrix products, a long one is cut into several."""
        lex, p = shared.value
        ctx, w = (np.concatenate([h[k] for h in held]) for k in range(2))
        each = np.concatenate([log_prob(lex, p, ctx[lo : lo + TOKENS], w[lo : lo + TOKENS]) for lo in range(0, len(w), TOKENS)])
        ends = np.cumsum([len(h[1]) for h in held])
        run = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
        return (np.diff(run[np.concatenate([[0], ends])]) / np.log(10)).tolist()

    def run(batches):
        for b in batches:
            held, n, net = [], 0, []
            for got in read(b, shared.value[0]):
                held.append(got)
                n += len(got[1])
                if n >= TOKENS:
                    net, held, n = net + nets(held), [], 0
            if held:
                net += nets(held)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(net, pa.float64())], [*kept, "net"])

    kept = ["row", "doc_id", "n_tokens", "n_known", "log_c", "inside"]
    kind = codes.schema["doc_id"].dataType.simpleString()
    done = codes.select(*kept, "out").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, log_c double, inside double, net double")
    rare = codes.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), "x.times")
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also")
    )
    unit = float(np.log10(lexicon.n + 0.5 * (lexicon.v + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return done.join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        (F.col("log_c") + more - F.col("n_tokens") * unit).alias("base_score"), (F.col("inside") + F.col("net") + more).alias("score"),
    )


def score(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, params: dict[str, np.ndarray]) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, n_known, base_score, score (log10)."""
    return scored(encoded(docs, lexicon), counts, lexicon, params)


def held_out(doc_id="doc_id", n: int = 5, at: int = 1):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)) == at, F.lit(False))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: all documents scored by counts and by the model of the training fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = materialise(word_counts(docs.where(~held_out())))
    lexicon = Lexicon(counts)
    codes = encoded(docs, lexicon)
    out = scored(codes, counts, lexicon, fit(codes.where(~held_out()), lexicon))
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.n).cast("long").alias("train_tokens"), "base_score", "score"
    )
