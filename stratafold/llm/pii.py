"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

Base spans. Four patterns, leftmost and non-overlapping per kind, with a check of each match (parts, Luhn, digits).
Model. Characters fall into classes; two LSTMs read a window in either direction, a linear layer scores tags (outside, and
begin and inside per kind), learnt transitions tie neighbouring tags; training is gradient descent (Adam) on the CRF's
likelihood of labelled spans: base spans in windows of a bounded sample of documents, and drawn examples of each kind,
also in forms that the patterns do not see: addresses with "(at)" and "dot", phone numbers without a country, addresses
with spaced or bracketed dots, cards with other separators or two in a row.
Decoding. Windows of `SPAN` characters overlap by half. A span holds a digit, an @ or a bracketed "at", so a window with
none is all outside by definition; all others are decoded by Viterbi. Each character takes the tag of the window in
which it stands most centrally, and spans are read from the whole text's tags, so none ends at a window's edge. A model
span is widened to whole words of letters and digits. It counts if it overlaps no base span and its kind's own test holds
(Luhn's sum, parts at most 255, number of digits, an address's form), so the model proposes and the test decides.

Defined cases. Null text is empty: no spans. Ties between windows go to the earlier one. Offsets are code points, ends
exclusive. Repeated rows get a row each. Other columns are kept by `redact`, ignored by `find`. Time is linear in text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
SPAN, HIDDEN, STEPS, BATCH = 64, 16, 150, 64
#: The fit's bounds: documents looked at and windows taken for training.
SAMPLE_ROWS, SAMPLE_WINDOWS = 20_000, 1_500
SEED = 7

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_trigger = re.compile(r"[0-9@]|[(\[{] ?(?:at|AT) ?[)\]}]")
#: What a model span of each kind must look like.
_email = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[{] ?(?:at|AT) ?[)\]}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[{] ?(?:dot|DOT) ?[)\]}]| dot ) ?[A-Za-z0-9-]+)+")
_parts = re.compile(r"([0-9]{1,3})(?: ?[(\[{]? ?(?:\.|dot) ?[)\]}]? ?([0-9]{1,3})){3}")
_number = re.compile(r"[0-9](?: ?[-./] ?[0-9]| {0,2}[0-9])+")
_local_phone = re.compile(r"(?:\(0?[0-9]{2,4}\)|\+[0-9]{1,3}|0[0-9]{1,4}|[2-9][0-9]{2}(?=[ .-][0-9]{3}[ .-][0-9]{4}$))[ ./-]{0,2}[0-9]{2,}(?:[ ./-][0-9]{2,})*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind, then start."""
    if not _trigger.search(text):
        return []
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # from each @ outwards: the pattern's leftmost matches without rescanning long runs
        m = _domain.match(text, at)
        if m:
            start = at
            while start > last and text[start - 1] in _local:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _phone.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- the model -------------------------------------------------------------------------------------------------------

_marks = "@.-+()_%=:/,;\"'| \n"
CLASSES = len(_marks) + 7
TAGS = 1 + 2 * len(KINDS)


def char_class(c: str) -> int:
    if "0" <= c <= "9":
        return 0
    k = _marks.find(c)
    if k >= 0:
        return 1 + k
    b = 1 + len(_marks)
    if c in "abcdef":
        return b
    if "a" <= c <= "z":
        return b + 1
    if "A" <= c <= "F":
        return b + 2
    if "A" <= c <= "Z":
        return b + 3
    return b + 4 if c.isalpha() else b + 5


_ascii_class = np.array([char_class(chr(k)) for k in range(128)] + [char_class("é")], np.int64)
PAD = CLASSES - 1


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _ascii_class[np.minimum(code, 128)]


def starts(n: int, span: int = SPAN) -> list[int]:
    """Windows that cover n characters, each overlapping the next by half; the last is anchored at the end."""
    if n <= span:
        return [0]
    return [*range(0, n - span, span // 2), n - span]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def init(rng) -> dict[str, np.ndarray]:
    h, p = HIDDEN, {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * h))
        p[f"x{d}"][:, h : 2 * h] += 0.5  # open forget gates
        p[f"u{d}"] = rng.normal(0, h**-0.5, (h, 4 * h))
    p["o"], p["ob"] = rng.normal(0, 0.2, (2 * h, TAGS)), np.zeros(TAGS)
    p["t"], p["s"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    return p


def lstm(p, d: str, x: np.ndarray, keep: bool):
    """Hidden states (T, B, H) of one direction over classes x (B, T); d = f or b."""
    h_n, (b_n, t_n) = HIDDEN, x.shape
    h, c = np.zeros((b_n, h_n)), np.zeros((b_n, h_n))
    hs, memo = np.zeros((t_n, b_n, h_n)), []
    for t in range(t_n) if d == "f" else range(t_n - 1, -1, -1):
        g = p[f"x{d}"][x[:, t]] + h @ p[f"u{d}"]
        s = sigmoid(g[:, : 3 * h_n])
        i, f, o, u = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :], np.tanh(g[:, 3 * h_n :])
        c2 = f * c + i * u
        tc = np.tanh(c2)
        if keep:
            memo.append((t, h, c, i, f, o, u, tc))
        h, c = o * tc, c2
        hs[t] = h
    return hs, memo


def unary(p, x, keep=False):
    f, mf = lstm(p, "f", x, keep)
    b, mb = lstm(p, "b", x, keep)
    both = np.concatenate([f, b], axis=2)
    return both @ p["o"] + p["ob"], both, mf, mb


def lse(a, axis):
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def gradients(p, x, y):
    """Mean negative log likelihood of tags y (B, T) and its gradients."""
    e, both, mf, mb = unary(p, x, True)
    t_n, b_n, _ = e.shape
    al, be = np.zeros_like(e), np.zeros_like(e)
    al[0] = p["s"] + e[0]
    for t in range(1, t_n):
        al[t] = e[t] + lse(al[t - 1][:, :, None] + p["t"][None], 1)
    for t in range(t_n - 2, -1, -1):
        be[t] = lse(p["t"][None] + (e[t + 1] + be[t + 1])[:, None, :], 2)
    z = lse(al[-1], 1)
    rows = np.arange(b_n)
    gold = p["s"][y[:, 0]] + sum(e[t, rows, y[:, t]] for t in range(t_n)) + sum(p["t"][y[:, t - 1], y[:, t]] for t in range(1, t_n))
    de = np.exp(al + be - z[None, :, None])
    g = {"s": de[0].sum(axis=0), "t": np.zeros_like(p["t"])}
    np.add.at(g["s"], y[:, 0], -1)
    for t in range(1, t_n):
        g["t"] += np.exp(al[t - 1][:, :, None] + p["t"][None] + (e[t] + be[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(g["t"], (y[:, t - 1], y[:, t]), -1)
    for t in range(t_n):
        de[t, rows, y[:, t]] -= 1
    g["o"], g["ob"] = np.einsum("tbh,tbk->hk", both, de), de.sum(axis=(0, 1))
    dboth = de @ p["o"].T
    h_n = HIDDEN
    for d, memo, dh_all in (("f", mf, dboth[:, :, :h_n]), ("b", mb, dboth[:, :, h_n:])):
        gx, gu = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"u{d}"])
        dh, dc = np.zeros((b_n, h_n)), np.zeros((b_n, h_n))
        for t, h, c, i, f, o, u, tc in reversed(memo):
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tc**2)
            dg = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
            np.add.at(gx, x[:, t], dg)
            gu += h.T @ dg
            dh, dc = dg @ p[f"u{d}"].T, dc * f
        g[f"x{d}"], g[f"u{d}"] = gx, gu
    return (z - gold).mean(), {k: v / b_n for k, v in g.items()}


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = init(rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(BATCH, len(x)))
        _, g = gradients(p, x[pick], y[pick])
        norm = max(1.0, sum((a**2).sum() for a in g.values()) ** 0.5 / 5)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k] / norm
            v[k] = 0.99 * v[k] + 0.01 * (g[k] / norm) ** 2
            p[k] -= 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def tags_of(n: int, spans) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a:b], y[a : a + 1] = k + 1, k
    return y


def drawn(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Drawn labelled windows: a span of each kind in turn, or a number that is none, amid words."""
    rng = np.random.default_rng(seed)
    pick = lambda a: a[rng.integers(len(a))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda k=0: "".join(pick("abcdefghiklmnoprstuvwéüñ") for _ in range(k or rng.integers(2, 10)))
    low = lambda: "".join(pick("abcdefghiklmnoprstuvw") for _ in range(rng.integers(3, 9)))
    def card() -> str:
        s = num(15)
        return next(s + d for d in "0123456789" if luhn(s + d))

    def failing() -> str:
        s = num(16)
        return s if not luhn(s) else failing()

    xs, ys = [], []
    for k in range(n):
        kind = (*KINDS, None)[k % 5]
        if kind == "email":
            s = f"{low()}{pick(['', '.', '_'])}{pick(['', num(2), low()])}@{low()}{pick(['', num(1)])}.{pick(['com', 'org', 'example.com', 'net', 'de'])}"
            if k % 3 == 0:
                at, dot = pick([(" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "."), (" [at] ", " dot "), ("[at]", "[dot]")])
                s = s.replace("@", at).replace(".", dot)
        elif kind == "ip":
            s = pick([".", ".", " . ", "[.]", "(.)"]).join(str(rng.integers(1, 256)) for _ in range(4))
        elif kind == "card":
            s = pick(["", "", " ", "-", ".", "/"]).join(re.findall("....", card()))
        elif kind == "phone":
            s = f"+{rng.integers(1, 99)}{pick([' ', '-', ' ('])}{num(3)}{pick([') ', ' ', '-'])}{num(3)}{pick(['-', ' ', ''])}{num(4)}"
            if k % 2:
                s = pick([f"(0{num(2)}) {num(3)}-{num(4)}", f"0{num(3)} {num(7)}", f"0{num(2)}/{num(7)}", f"({num(3)}) {num(3)}-{num(4)}", f"{rng.integers(2, 10)}{num(2)}-{num(3)}-{num(4)}"])
        else:
            s = pick([f"{num(4)}", f"{num(1)}.{num(1)}", f"key={''.join(pick('0123456789abcdef') for _ in range(18))}", f"{num(2)}.", f"AK{''.join(pick('ABCDEFGHJKLMNPQRSTUVWXYZ0123456789') for _ in range(16))}", f"{num(2)}:{num(2)}", f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", failing(), f"{num(1)}.{num(2)}.{num(1)}", f"(at) {low()}", num(12)])
        more = pick(["", "", f" {s}"]) if kind == "card" and s.isdigit() else ""  # two in a row are two spans
        left = " ".join(word() for _ in range(6)) + pick([" ", "\n", " ", "("])
        text = left + s + more + pick([" ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(12))
        off = int(rng.integers(0, max(1, min(len(left), len(text) - SPAN))))
        spans = [(kind, len(left), len(left) + len(s))] if kind else []
        if more:
            spans.append((kind, spans[0][2] + 1, spans[0][2] + len(more)))
        y = tags_of(len(text), spans)
        xs.append(classes(text[off : off + SPAN]))
        ys.append(y[off : off + SPAN])
    full = [k for k in range(n) if len(xs[k]) == SPAN]
    return np.array([xs[k] for k in full]), np.array([ys[k] for k in full])


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS) -> dict[str, np.ndarray]:
    """The model, fitted to windows of about `rows` documents labelled by their base spans, and to drawn examples."""
    import pyarrow as pa

    def label(batches):
        for b in batches:
            xs, ys = [], []
            for text in b.column("text").to_pylist():
                if not _trigger.search(text):
                    continue
                y, x = tags_of(len(text), base_spans(text)), classes(text)
                for a in starts(len(text)):
                    w = x[a : a + SPAN]
                    if len(w) == SPAN and ((w == 0) | (w == 1)).any():
                        xs.append(bytes(w.astype(np.uint8)))
                        ys.append(bytes(y[a : a + SPAN].astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])

    some = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    keep = min(1.0, rows / max(1, some.count()))
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(keep * (1 << 30)) + 1)
    got = some.select("text").mapInArrow(label, "x binary, y binary").orderBy(F.xxhash64("x", "y"), "x", "y").limit(windows).collect()
    x, y = drawn(windows)
    if got:
        x = np.concatenate([x, [np.frombuffer(r["x"], np.uint8) for r in got]]).astype(np.int64)
        y = np.concatenate([y, [np.frombuffer(r["y"], np.uint8) for r in got]]).astype(np.int64)
    return fit(x, y)


def decode(p, x: np.ndarray) -> np.ndarray:
    """Viterbi tags (B, T) of windows x (B, T)."""
    e = unary(p, x)[0]
    t_n, b_n, _ = e.shape
    v, back = p["s"] + e[0], np.zeros(e.shape, np.int8)
    for t in range(1, t_n):
        s = v[:, :, None] + p["t"][None]
        back[t] = s.argmax(axis=1)
        v = s.max(axis=1) + e[t]
    y = np.zeros((b_n, t_n), np.int64)
    y[:, -1] = v.argmax(axis=1)
    for t in range(t_n - 1, 0, -1):
        y[:, t - 1] = back[t][np.arange(b_n), y[:, t]]
    return y


def model_spans(p, texts: list[str], block: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans of each whole text by the model alone, windows of all texts decoded together."""
    at, wins = [], []  # at: text, start of the window, its place in wins (none if it is all outside)
    for k, text in enumerate(texts):
        hits = [m.start() for m in _trigger.finditer(text)]
        if not hits:
            continue
        x, hits = classes(text), np.array(hits)
        for a in starts(len(text)):
            lo = np.searchsorted(hits, a)
            found = lo < len(hits) and hits[lo] < a + SPAN
            at.append((k, a, len(wins) if found else None))
            if found:
                w = x[a : a + SPAN]
                wins.append(np.concatenate([w, np.full(SPAN - len(w), PAD)]))
    tags = [t for lo in range(0, len(wins), block) for t in decode(p, np.array(wins[lo : lo + block]))]
    outside = np.zeros(SPAN, np.int64)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    centre = SPAN / 2 - np.abs(np.arange(SPAN) - (SPAN - 1) / 2)
    for k, a, w in at:
        t = outside if w is None else tags[w]
        if k not in best:
            best[k] = np.zeros(len(texts[k]), np.int64), np.zeros(len(texts[k]))
        y, how = best[k]
        n = min(SPAN, len(y) - a)
        c = centre[:n] + (SPAN if a == 0 else 0) * (np.arange(n) < SPAN // 2)
        win = c > how[a : a + n]
        y[a : a + n][win], how[a : a + n][win] = t[:n][win], c[win]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k, (y, _) in best.items():
        kind = (y + 1) // 2
        cuts = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (y[1:] % 2 == 1), [True]]))
        out[k] = [(KINDS[kind[a] - 1], int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if kind[a]]
    return out


def plausible(kind: str, s: str) -> bool:
    """The test of each kind that a model span must pass."""
    d = digits_of(s)
    if kind == "email":
        return bool(_email.fullmatch(s))
    if kind == "ip":
        return bool(_parts.fullmatch(s)) and all(int(x) <= 255 for x in re.findall("[0-9]+", s))
    if kind == "card":
        return bool(_number.fullmatch(s)) and 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 2
    return bool(_local_phone.fullmatch(s)) and 9 <= len(d) <= 15 and not re.fullmatch(r"[0-9]{1,4}([-./])[0-9]{1,2}\1[0-9]{1,4}", s)


def widened(text: str, a: int, b: int) -> tuple[int, int]:
    """The span (a, b) without white space and stops at its ends, then widened to whole runs of letters and digits, and
    to a bracket that opens before it."""
    while a < b and (text[a].isspace() or text[a] in ".,;:"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
        b -= 1
    while a and b > a and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and b > a and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    if a and b > a and text[a - 1] in "(+" and text[a - 1] not in text[a:b]:
        a -= text[a - 1] == "+" or ")" in text[a:b]
    return a, b


def candidates(text: str, spans) -> list[tuple[str, int, int]]:
    """The model's spans widened; those with too many digits for one number also as their parts between blanks."""
    out = []
    for kind, a, b in spans:
        a, b = widened(text, a, b)
        out.append((kind, a, b))
        if kind in ("card", "phone") and len(digits_of(text[a:b])) > 15:
            out += [(kind, a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
    return out


def spans_of(p, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans and all spans (base ones and plausible model spans that overlap none of them)."""
    out = []
    for text, more in zip(texts, model_spans(p, texts), strict=True):
        base = base_spans(text)
        new: list[tuple[str, int, int]] = []
        for kind, a, b in candidates(text, more):
            if plausible(kind, text[a:b]) and all(b <= c or a >= d for _, c, d in base + new):
                new.append((kind, a, b))
        out.append((base, sorted([*base, *new], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, base and spans, arrays of (kind, start, end) by kind, then start."""
    import pyarrow as pa

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]

    def run(batches):
        for b in batches:
            got = spans_of(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([named(g[k]) for g in got], item) for k in (0, 1))], ["doc_id", "base", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {SPANS}, spans {SPANS}")


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with each found span of `text` replaced by its kind in brackets; all columns stay, null texts too."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            out = []
            for text, (_, spans) in zip(texts, spans_of(model, [t or "" for t in texts]), strict=True):
                last, parts = 0, []
                for kind, a, e in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if e > last:
                        parts += [text[last : max(a, last)], f"[{kind}]" if a >= last else ""]
                        last = e
                out.append(None if text is None else "".join(parts) + text[last:])
            k = b.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(out, pa.string()), *b.columns[k + 1 :]], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))
