"""BPE encoding and decoding by tree concatenation, and token counts from distinct pre-tokens.

Encoding. White space is a boundary that no merge crosses, so a word between ASCII white space is encoded once and kept
in a bounded per-worker table. Texts beyond `split_bytes` are cut into leaves at arbitrary characters; the leaves are
encoded by different tasks and concatenated as a tree. Where a leaf begins or ends in white space, both sides agree at
once; else the open words at its ends wait for their neighbours. An open word beyond `OPEN` bytes, as of unsplit text, is
encoded by its leaf's task, with the places of its tokens: around each join a window of characters that doubles is
encoded again until it shares a token with either side. A token sequence is the BPE encoding of its text exactly if each
adjacent pair of tokens is the encoding of its own text, and a pre-token's extent is known to whoever sees its front and
its end, so one shared token on either side proves the concatenation exact; a window that has grown to both ends is
exact by definition. Inside a task the pre-tokens of words beyond `long_word` characters are halved down to `leaf`
symbols and joined in the same way.

Counts. A text is cut at the spaces that follow a character other than white space, where the byte-level pattern always
begins a new pre-token. The distinct pieces of the corpus are gathered (combined per task, then by key), each is counted
once, and the counts are joined to the documents' piece frequencies and summed; ids are never kept. The `FREQUENT` most
frequent pieces are joined by a broadcast, all others by a shuffle on a 64-bit hash; pieces whose hashes collide (told
by the table itself) are broadcast too. Pieces beyond `LONG_PIECE` characters never travel, they are counted in place.

Defined cases. Null text is empty: no tokens. Repeated rows get a row each. Special strings in texts are special tokens,
as the library has it. Other columns are ignored. Tokenizer files are a parameter; nothing is trained.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent, materialise, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Entries of the per-worker table of encoded words.
CACHE = 300_000
SPLIT_BYTES = 1 << 16
LONG_WORD, LEAF, WINDOW = 512, 128, 16

#: Patterns of the two tokenizers' pre-tokenizers, as their files have them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these characters classes and normal forms may depend on a library's Unicode version: then the library decides.
UNUSUAL = re.compile("[^\t\n\r -~\u00a1-\u024f]|<\\|")

_open: dict = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves,
    the others take the characters from U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


BYTE_LETTERS = byte_letters()


def spelt(s: str) -> str:
    return s if s.isascii() and s.isalnum() else "".join([BYTE_LETTERS[b] for b in s.encode()])


def tokenizer(path: str):
    """The tokenizer of `path`, once per process, on one thread."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _open[path] = Tokenizer.from_file(path)
    return _open[path]


def tree_tokens(model, s: str, leaf: int = LEAF, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens of one pre-token `s`, by halves and growing windows."""

    def plain(lo: int, hi: int) -> list[tuple[int, int, int]]:
        out, at, tokens = [], lo, model.tokenize(s[lo:hi])
        for k, t in enumerate(tokens):
            end = hi if k == len(tokens) - 1 else at + len(t.value)
            out.append((at, end, t.id))
            at = end
        return out

    def join(left: list, right: list, lo: int, mid: int, hi: int) -> list:
        w = window
        while True:
            i = next((k for k in range(len(left) - 1, -1, -1) if left[k][0] <= mid - w), 0)
            j = next((k for k in range(len(right)) if right[k][1] >= mid + w), len(right) - 1)
            a, b = left[i][0], right[j][1]
            got = plain(a, b)
            agrees_left = a == lo or got[0] == left[i]
            ends = {t: k for k, t in enumerate(right[: j + 1])}
            last = len(got) - 1 if b == hi else next((k for k in range(len(got) - 2, 0, -1) if got[k] in ends), None)
            if agrees_left and last is not None:
                rest = [] if b == hi else right[ends[got[last]] + 1 :]
                return left[:i] + got[: last + 1] + rest
            w *= 2

    def tree(lo: int, hi: int) -> list:
        if hi - lo <= leaf:
            return plain(lo, hi)
        mid = (lo + hi) // 2
        return join(tree(lo, mid), tree(mid, hi), lo, mid, hi)

    return tree(0, len(s)) if s else []


class WordEncoder:
    """Words (bytes without ASCII white space) to id bytes and decoded bytes, each kept once in a bounded table."""

    def __init__(self, path: str, cache: int = CACHE, long_word: int = LONG_WORD):
        self.tok, self.most, self.long_word = tokenizer(path), cache, long_word
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = [(self.tok.id_to_token(i) or "") for i in range(size)]
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.split = regex.compile(WORD_PATTERN)
        self.parts: dict[str, tuple[bytes, bytes]] = {}  # pre-tokens
        self.ids: dict[bytes, bytes] = {}  # words
        self.text: dict[bytes, bytes] = {}

    def long_ids(self, word: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(word):
            if part in self.special:
                out.append(self.special[part])
                continue
            for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                out += [i for _, _, i in tree_tokens(self.tok.model, s)]
        return out

    def both(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join([i.to_bytes(4, "little") for i in ids]), "".join([f"{self.names[i]} " for i in ids]).encode()

    def part(self, s: str) -> tuple[bytes, bytes]:
        got = self.parts.get(s)
        if got is None:
            if len(self.parts) > self.most:
                self.parts.clear()
            got = self.parts[s] = self.both([t.id for t in self.tok.model.tokenize(spelt(s))])
        return got

    def word(self, w: str) -> tuple[bytes, bytes]:
        if len(w) > self.long_word:
            return self.both(self.long_ids(w))
        if UNUSUAL.search(w):
            return self.both(self.tok.encode(w, add_special_tokens=False).ids)
        parts = [self.part(s) for s in self.split.findall(w.lower())]
        return parts[0] if len(parts) == 1 else (b"".join([x[0] for x in parts]), b"".join([x[1] for x in parts]))

    def learn(self, words: set[bytes]) -> None:
        if len(self.ids) + len(words) > self.most:
            self.ids.clear()
            self.text.clear()
        for w in words:
            if w not in self.ids:
                self.ids[w], self.text[w] = self.word(w.decode())

    def forget(self) -> None:
        """Empties the tables: the worker's memory is the next stage's."""
        self.parts.clear()
        self.ids.clear()
        self.text.clear()

    def encode(self, words: list[bytes]) -> tuple[bytes, bytes]:
        """Id bytes, and the decoded tokens, each followed by a space."""
        try:
            return b"".join([self.ids[w] for w in words]), b"".join([self.text[w] for w in words])
        except KeyError:
            self.learn(set(words))
            return b"".join([self.ids[w] for w in words]), b"".join([self.text[w] for w in words])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


SPACES = b" \t\n\r\x0b\x0c"


#: Bytes of an open word from which on its tokens are kept; characters of the first window around a join.
OPEN, FIRST = 2048, 64


def placed(tok, text: str, at: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens of `text`, places in characters from `at`."""
    e = tok.encode(text, add_special_tokens=False)
    return [(a + at, b + at, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]


def alone(t: list, k: int) -> bool:
    """Whether token `k` shares no character with its neighbours (a character may be cut into several tokens)."""
    return (k == 0 or t[k - 1][1] <= t[k][0]) and (k + 1 == len(t) or t[k][1] <= t[k + 1][0])


def joined_tokens(tok, x: str, a: list, y: str, b: list, first: int = FIRST) -> list:
    """Tokens of x + y from those of `x` and of `y`, by windows around the join that grow until both sides agree."""
    mid, text, w = len(x), x + y, first
    b = [(s + mid, e + mid, i) for s, e, i in b]
    while True:
        lo, hi = max(0, mid - w), min(len(text), mid + w)
        got = placed(tok, text[lo:hi], lo)
        here = {t: k for k, t in enumerate(a) if t[0] >= lo and alone(a, k)}
        there = {t: k for k, t in enumerate(b) if t[1] <= hi and alone(b, k)}
        left = 0 if lo == 0 else next((k for k in range(1, len(got)) if got[k] in here and alone(got, k)), None)
        right = len(got) if hi == len(text) else next((k for k in range(len(got) - 2, -1, -1) if got[k] in there and alone(got, k)), None)
        if left is not None and right is not None and left <= right:
            front = [] if lo == 0 else a[: here[got[left]]]
            return front + got[left:right] + ([] if hi == len(text) else b[there[got[right]] :])
        w *= 2


def packed(t: list) -> bytes:
    import numpy as np

    return np.array(t, np.int64).tobytes()


def unpacked(t: bytes) -> list:
    import numpy as np

    return list(map(tuple, np.frombuffer(t, np.int64).reshape(-1, 3).tolist()))


NONE = (b"", None)


def opened(word: bytes, enc: WordEncoder, least: int = OPEN) -> tuple[bytes, bytes | None]:
    """An open word and, if it is long, its tokens."""
    return word, packed(placed(enc.tok, word.decode())) if len(word) >= least else None


def glued(a: tuple, b: tuple, enc: WordEncoder, least: int = OPEN) -> tuple[bytes, bytes | None]:
    """Two open words as one."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    if a[1] is None and b[1] is None:
        return opened(a[0] + b[0], enc, least)
    (x, s), (y, t) = ((w.decode(), unpacked(k) if k is not None else placed(enc.tok, w.decode())) for w, k in (a, b))
    return a[0] + b[0], packed(joined_tokens(enc.tok, x, s, y, t))


def settled(word: tuple, enc: WordEncoder) -> tuple[bytes, bytes]:
    if word[1] is not None:
        return enc.both([i for _, _, i in unpacked(word[1])])
    return enc.encode([word[0]]) if word[0] else (b"", b"")


def leaf_piece(data: bytes, enc: WordEncoder, least: int = OPEN) -> tuple:
    """A leaf as (head, its tokens, ids, text, tail, its tokens): the open word at either end and the encoded words
    between; a leaf without white space is all head and has None for ids and text."""
    words = data.split()
    inner = len(words) > 1 or not words or data[0] in SPACES or data[-1] in SPACES
    if not inner:
        return *opened(data, enc, least), None, None, *NONE
    head = b"" if not words or data[0] in SPACES else words.pop(0)
    tail = b"" if not words or data[-1] in SPACES else words.pop()
    return *opened(head, enc, least), *enc.encode(words), *opened(tail, enc, least)


def concat(a: tuple, b: tuple, enc: WordEncoder, least: int = OPEN) -> tuple:
    """Two neighbouring pieces as one: what spans the join is one word."""
    if a[2] is None:
        return *glued(a[:2], b[:2], enc, least), *b[2:]
    if b[2] is None:
        return *a[:4], *glued(a[4:], b[:2], enc, least)
    ids, text = settled(glued(a[4:], b[:2], enc, least), enc)
    return *a[:2], a[2] + ids + b[2], a[3] + text + b[3], *b[4:]


def concat_all(pieces: list[tuple], enc: WordEncoder, least: int = OPEN) -> tuple[bytes, bytes]:
    """Pieces in order to the id bytes and decoded text of the whole, joined pairwise as a tree."""
    while len(pieces) > 1:
        pieces = [concat(*pieces[k : k + 2], enc, least) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    p = pieces[0]
    first, last = settled(p[:2], enc), settled(p[4:], enc)
    return first[0] + (p[2] or b"") + last[0], (first[1] + (p[3] or b"") + last[1])[:-1]


def leaves(data: bytes, size: int) -> list[bytes]:
    """`data` halved at characters until each part has at most `size` bytes."""
    if len(data) <= size:
        return [data]
    mid = len(data) // 2
    while 0 < mid < len(data) and data[mid] & 0xC0 == 0x80:
        mid += 1
    return leaves(data[:mid], size) + leaves(data[mid:], size)


ENCODED = "ids binary, decoded binary"
PIECE = ("head", "head_tokens", "ids", "decoded", "tail", "tail_tokens")


def encode(docs: DataFrame, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, ids (little-endian unsigned 32-bit), decoded (UTF-8 of the library's
    decode of these ids, special tokens kept)."""
    import pyarrow as pa

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        enc = encoder(path)
        for b in batches:
            out = [enc.encode(t.split()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1][:-1] for x in out], pa.binary())],
                ["doc_id", "ids", "decoded"],
            )
        enc.forget()

    def cut(batches):
        for b in batches:
            for row, doc, text in zip(b.column("row").to_pylist(), b.column("doc_id"), b.column("text").to_pylist(), strict=True):
                parts = leaves(text, split_bytes // 2)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([doc.as_py()] * n, b.schema.field("doc_id").type), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())],
                    ["row", "doc_id", "leaf", "text"],
                )

    def encoded(batches):
        enc = encoder(path)
        for b in batches:
            out = [leaf_piece(t, enc) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "doc_id", "leaf")), *(pa.array([x[k] for x in out], pa.binary()) for k in range(6))],
                ["row", "doc_id", "leaf", *PIECE],
            )
        enc.forget()

    def joined(pdf):
        import pandas as pd

        pdf = pdf.sort_values("leaf")
        pieces = list(zip(*(pdf[c] for c in PIECE), strict=True))
        ids, text = concat_all(pieces, encoder(path))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1].array, "ids": [ids], "decoded": [text]})

    size = F.octet_length("text")
    short = rows.where(size <= split_bytes).mapInArrow(whole, f"doc_id {kind}, {ENCODED}")
    long = rows.where(size > split_bytes).withColumn("row", F.monotonically_increasing_id())
    parts = long.mapInArrow(cut, f"row long, doc_id {kind}, leaf int, text binary").repartition("row", "leaf")
    pieces = parts.mapInArrow(encoded, f"row long, doc_id {kind}, leaf int, " + ", ".join(f"{c} binary" for c in PIECE))
    return short.unionByName(pieces.groupBy("row").applyInPandas(joined, f"doc_id {kind}, {ENCODED}"))


def decode(ids: bytes, path: str) -> str:
    """Id bytes (little-endian unsigned 32-bit) back to the library's text of these tokens."""
    names = encoder(path).names
    return " ".join(names[int.from_bytes(ids[k : k + 4], "little")] for k in range(0, len(ids), 4))


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document encoded and decoded."""
    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_byte_split = regex.compile(BYTE_PATTERN)
_ends_in_space = re.compile(r"\s ")
_starts = re.compile(r"(?<=\S)(?= )")


def pieces(text: str) -> list[str]:
    """`text` cut before each space that follows a character other than white space."""
    if _ends_in_space.search(text):
        return _starts.split(text)
    first, *rest = text.split(" ")
    out = [f" {x}" for x in rest]
    if first:
        out.append(first)
    return out


#: Pieces that are broadcast; distinct pieces that a task gathers before it lets go; characters of a piece that travels.
FREQUENT, HELD, LONG_PIECE = 131_072, 500_000, 256


def piece_key(piece: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(piece.encode()) - (1 << 63)


def piece_tokens(piece: str, tok, known: dict[str, int], cache: int = CACHE) -> int:
    """Tokens of one piece; its pre-tokens are kept in `known`."""
    if UNUSUAL.search(piece):
        return len(tok.encode(piece, add_special_tokens=False).ids)
    total = 0
    for s in _byte_split.findall(piece):
        n = known.get(s)
        if n is None:
            if len(known) > cache:
                known.clear()
            n = known[s] = len(tok.model.tokenize(spelt(s)))
        total += n
    return total


def distinct_pieces(rows: DataFrame, path: str, held: int = HELD, key=piece_key) -> DataFrame:
    """word (the piece), h (its key), c (occurrences), same (distinct pieces with that key), n (its tokens): one row for
    every distinct piece of `rows` (text), each counted once; written once."""
    import pyarrow as pa
    from pyspark.sql import Window

    def gather(batches):
        c: Counter = Counter()

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([key(p) for p in c], pa.int64()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["h", "word", "c"])

        for b in batches:
            for t in b.column("text").to_pylist():
                c.update(pieces(t))
            if len(c) > held:
                c = Counter({p: k for p, k in c.items() if len(p) <= LONG_PIECE})
                yield emit()
                c = Counter()
        c = Counter({p: k for p, k in c.items() if len(p) <= LONG_PIECE})
        yield emit()

    def count(batches):
        tok, parts = tokenizer(path), {}
        for b in batches:
            n = [piece_tokens(p, tok, parts) for p in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "n"])

    all_ = rows.select("text").mapInArrow(gather, "h long, word string, c long").repartition("h")
    one = all_.groupBy("h", "word").agg(F.sum("c").alias("c")).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("h")))
    return materialise(one.mapInArrow(count, "h long, word string, c long, same long, n long"))


def token_counts(docs: DataFrame, path: str, limit: int = 512, most: int = FREQUENT, key=piece_key) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    import pyarrow as pa

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    table_ = distinct_pieces(rows, path, key=key)
    known = {r["word"]: r["n"] for r in frequent(table_, most)}
    known |= {r["word"]: r["n"] for r in table_.where("same > 1").collect()}  # next to none at 64 bits
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def split(batches):
        """The sum over frequent pieces, and the others with their frequencies."""
        tok, find, parts = tokenizer(path), shared.value, {}
        for b in batches:
            sums, keys, times = [], [], []
            for t in b.column("text").to_pylist():
                total, rare = 0, {}
                for p, k in Counter(pieces(t)).items():
                    n = find.get(p)
                    if n is not None:
                        total += n * k
                    elif len(p) > LONG_PIECE:
                        total += piece_tokens(p, tok, parts) * k
                    else:
                        rare[p] = k
                sums.append(total)
                keys.append([key(p) for p in rare])
                times.append(list(rare.values()))
            cols = [pa.array(sums, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], ["doc_id", "n_bytes", "sums", "keys", "times"])

    done = rows.mapInArrow(split, f"doc_id {kind}, n_bytes long, sums long, keys array<long>, times array<long>")
    done = materialise(done.withColumn("row", F.monotonically_increasing_id()))
    rare = done.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("h"), "x.times")
    more = rare.join(table_.where("same = 1").select("h", "n"), "h").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"))
    n = F.col("sums") + F.coalesce("more", F.lit(0))
    return done.join(more, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
