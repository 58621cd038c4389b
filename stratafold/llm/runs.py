"""Periodic runs of words by Crochemore's partition refinement.

A run is a stretch of words with smallest period q, at least twice q and at least `least` words long, that no
neighbouring word extends. Positions of a text are kept in classes of equal factors of length L. Refining L to L + 1
splits a class by the classes of the following positions; only the classes that are not the largest part of their
parent have to be looked at (the smaller half), so a position is moved at most log2(n) times. The members of a class
form a list in text order. Two neighbours in it at distance L are a square of period L: nearer members would mean a
shorter period. Whenever two positions become neighbours their distance is noted, so that length L finds its squares
without a search; squares at adjacent starts are merged into a run.

The first `FEW` lengths, where nearly all positions are in small classes, are refined for all texts of a batch together
with array operations; texts in which a factor of that length repeats go on one by one.

Scale. One pass over the texts, no shuffle; a task holds about `BATCH_WORDS` words or one text, about 300 bytes a word.
n log n steps a text, whatever it repeats.

Defined cases. Null, empty and blank texts have no words and no run. A null doc_id is kept. Repeated rows get a row each.
Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FEW, BATCH_WORDS, LEAST = 6, 1 << 18, 12


class _Ids(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def looped(doc_id: int | None, words: list) -> list:
    """The words with a loop planted into the tail of one text in ten, chosen by a checksum of its id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def _merged(starts: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """First starts and lengths of the runs that squares of one period at these ascending starts form."""
    first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] - starts[first] + 2 * period


def short_periods(ids: np.ndarray, few: int = FEW, least: int = LEAST) -> tuple[list, np.ndarray]:
    """Runs (start, length, period) with periods below `few`, and the classes of factors of length `few`, -1 for factors
    that occur once. `ids` has a word's number at its place and -1 after each text; equal words of two texts differ."""
    cls = np.full(len(ids), -1)
    at = np.flatnonzero(ids >= 0)
    key, found = ids[at], []
    for length in range(1, few + 1):
        if length > 1:
            at = at[cls[at + 1] >= 0]
            key = cls[at] * len(ids) + cls[at + 1]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.diff(key, prepend=-1) != 0
        many = ~new | ~np.append(new[1:], True)  # has an equal neighbour
        at, label = at[many], np.cumsum(new)[many]
        cls[:] = -1
        cls[at] = label
        if length < few:
            square = at[:-1][(np.diff(at) == length) & (label[1:] == label[:-1])]
            for s, n in zip(*_merged(np.sort(square), length), strict=True) if len(square) else ():
                if n >= least:
                    found.append((int(s), int(n), length))
        at = np.sort(at)
    return found, cls


class Partition:
    """Classes of the positions of one text whose factors of the current length occur elsewhere, and their neighbours."""

    def __init__(self, cls: list[int], length: int):
        self.length, self.half = length, len(cls) // 2
        self.cls, self.members = cls, {}
        self.next, self.before = [-1] * len(cls), [-1] * len(cls)
        self.due: dict[int, list[int]] = {}  # distance: positions whose next member was noted at it
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(cls):
            if c >= 0:
                groups.setdefault(c, []).append(i)
        self.size, self.head, self.alive = [], [], 0
        for g in groups.values():
            self._found(g)
        # at the start every class is looked at, those of one member as well
        cls = self.cls
        self.small = [*groups.values(), *([i] for i in range(1, len(cls)) if cls[i] < 0 <= cls[i - 1])]
        if cls and cls[-1] >= 0:
            self.small.append([len(cls)])

    def _found(self, group: list[int]) -> None:
        """Makes `group` (ascending) a class of its own."""
        if len(group) == 1:
            self.cls[group[0]] = self.next[group[0]] = -1
            return
        name, last, cls, nxt, before = len(self.size), -1, self.cls, self.next, self.before
        for i in group:
            cls[i] = name
            before[i] = last
            if last >= 0 and nxt[last] != i:
                nxt[last] = i
                if i - last <= self.half:
                    self.due.setdefault(i - last, []).append(last)
            last = i
        nxt[last] = -1
        self.size.append(len(group))
        self.head.append(group[0])
        self.alive += len(group)

    def squares(self) -> list[int]:
        """Ascending starts of the squares whose period is the current length."""
        nxt, length = self.next, self.length
        return sorted({i for i in self.due.pop(length, ()) if nxt[i] == i + length})

    def refine(self) -> None:
        """From factors of length L to L + 1."""
        cls, nxt, before, size, head = self.cls, self.next, self.before, self.size, self.head
        touched: dict[int, list[list[int]]] = {}
        for group in self.small:
            part: dict[int, list[int]] = {}
            for i in group:
                c = cls[i - 1] if i else -1
                if c >= 0:
                    part.setdefault(c, []).append(i - 1)
            for c, g in part.items():
                touched.setdefault(c, []).append(g)
        self.small = []
        self.length += 1
        for c, groups in touched.items():
            rest = size[c] - sum(map(len, groups))
            if not rest and len(groups) == 1:
                continue
            self.alive -= size[c]
            if rest:
                for g in groups:
                    for i in g:
                        b, n = before[i], nxt[i]
                        if b >= 0:
                            nxt[b] = n
                            if n >= 0 and self.length <= n - b <= self.half:
                                self.due.setdefault(n - b, []).append(b)
                        else:
                            head[c] = n
                        if n >= 0:
                            before[n] = b
                size[c] = rest
                self.alive += rest
            most = max(groups, key=len)
            for g in groups:
                if rest >= len(most) or g is not most:
                    self.small.append(g)
                self._found(g)
            if rest and rest < len(most):
                i, left = head[c], []
                while i >= 0:
                    left.append(i)
                    i = nxt[i]
                self.small.append(left)
            if rest == 1:
                self.alive -= 1
                cls[head[c]] = nxt[head[c]] = -1


def long_periods(cls: list[int], length: int = FEW, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) with periods of `length` or more of the text whose factors of that length have the
    classes `cls` (-1: occurs once)."""
    part, found = Partition(cls, length), []
    while part.length <= part.half and part.alive:
        starts = part.squares()
        if starts:
            for s, n in zip(*_merged(np.array(starts), part.length), strict=True):
                if n >= least:
                    found.append((int(s), int(n), part.length))
        part.refine()
    return found


def runs_of(texts: list[list], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text (a list of words) its runs (start, length, period) by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    numbers, ids = _Ids(), np.full(first[-1], -1)
    for k, t in enumerate(texts):
        ids[first[k] : first[k] + len(t)] = np.fromiter(map(numbers.__getitem__, t), np.int64, len(t))
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    ids = np.where(ids < 0, -1, text * len(numbers) + ids)
    short, cls = short_periods(ids, least=least)
    out: list[list] = [[] for _ in texts]
    for s, n, q in short:
        out[text[s]].append((s - int(first[text[s]]), n, q))
    for k in np.unique(text[cls >= 0]).tolist():
        if lengths[k] >= 2 * FEW:
            out[k] += long_periods(cls[first[k] : first[k] + lengths[k]].tolist(), least=least)
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, least: int = LEAST, loops: bool = False) -> DataFrame:
    """docs (doc_id, text) to doc_id, runs (array of start, length, period, by start, then period) and collapsed, the text
    of the words that no run contains after its first period, joined by one space. With `loops` the texts are changed by
    `looped` first."""
    import pyarrow as pa

    docs = docs.select("doc_id", "text")
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        ids, texts, held = [], [], 0

        def flush():
            runs = runs_of(texts, least)
            rows = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs]
            kept = [b" ".join(collapsed(t, r)) for t, r in zip(texts, runs, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(rows, pa.list_(struct)), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

        for b in batches:
            kind = b.schema.field("doc_id").type
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []  # of bytes: splits at exactly the six ASCII blanks
                ids.append(i)
                texts.append(looped(i, words) if loops else words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield flush()
                    ids, texts, held = [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the runs of every document, the longest of them, and digests of runs and collapsed text."""
    out = periodic_runs(table(spark, sf_dir, "documents"), loops=True)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.n div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: CRC-32 in SQL: the table from its polynomial, then one step a byte.
CRC_SQL = r"""
crc_table as materialized (
  select list(list_reduce([n] || range(8)::bigint[], lambda c, _: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as crc
  from (select unnest(range(256))::bigint as n))"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's bytes, where `crc`, the column of `crc_table`, is in scope."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2])::bigint)"
    return f"xor(4294967295, list_reduce([4294967295::bigint] || {codes}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"


OP12_SQL = rf"""
with {CRC_SQL},
given as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
hashed as (select doc_id, w, len(w) as n, {crc_sql("doc_id::varchar")} as h from given, crc_table),
tail as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n else n end as a from hashed),
loops as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from tail),
texts as (select doc_id, n, case when a < n then w[1:a] || list_transform(range(n - a), lambda i: w[a + i % p + 1]) else w end as w from loops),
words as materialized (select doc_id, n, unnest(range(n)) as i, unnest(w) as word from texts),
numbered as materialized (select doc_id, n, i, dense_rank() over (order by word) as c from words),
grams as materialized (select doc_id, n, i, hash(c, c1, c2, c3, c4, c5) as g from (
  select *, lead(c, 1) over d as c1, lead(c, 2) over d as c2, lead(c, 3) over d as c3, lead(c, 4) over d as c4, lead(c, 5) over d as c5
  from numbered window d as (partition by doc_id order by i)) where i + 6 <= n),
periods as materialized (select distinct x.doc_id, y.i - x.i as q from grams x join grams y on x.doc_id = y.doc_id and x.g = y.g and y.i > x.i and 2 * (y.i - x.i) <= x.n),
equal as (select q.doc_id, q.q, x.i, x.i - row_number() over (partition by q.doc_id, q.q order by x.i) as k
  from periods q join numbered x on q.doc_id = x.doc_id join numbered y on q.doc_id = y.doc_id and y.i = x.i + q.q and y.c = x.c),
stretches as materialized (select doc_id, q, min(i) as s, count(*) + q as len from equal group by doc_id, q, k having count(*) + q >= greatest(12, 2 * q)),
runs as materialized (select * from stretches a where not exists (
  select 1 from stretches b where b.doc_id = a.doc_id and b.q < a.q and b.s <= a.s and b.s + b.len >= a.s + a.len)),
listed as (select doc_id, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as lines,
  arg_min({{'s': s, 'len': len, 'q': q}}, {{'n': -len, 's': s, 'q': q}}) as best from runs group by doc_id),
dropped as (select distinct doc_id, unnest(range(s + q, s + len)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from words anti join dropped using (doc_id, i) group by doc_id)
select t.doc_id, coalesce(n_runs, 0) as n_runs, best.s::bigint as start, best.len::bigint as length, best.q::bigint as period, (1000 * best.len // best.q)::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.t, '')) as collapsed_sha256
from texts t left join listed using (doc_id) left join kept k using (doc_id)
"""
