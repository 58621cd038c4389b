"""Main-text extraction from raw pages by nearest-URL page differencing.

Lines. A page is read into text lines, one per block element. Elements that are never article text (menus, headers,
footers, asides, forms, scripts, adverts, notices, comments, by tag, role, or a class or id made of such names only, for
adverts, notices, comments and forms also beside other words, as `reader-comments` or `promo-2024`) give none. Every other line has a mark: inside an article or main element, outside, or doubtful (in an element inside the
article whose class or id only partly has such a name, as `share-price` or `related-work`).
Differencing. The distinct pages of a host are ordered by URL path and id; each is paired with the nearest of them, of
`REACH` on either side the one whose path shares the longest prefix (then the closer, then the earlier). All lines of both are aligned by a
longest common subsequence and shared lines are deleted: what the site repeats goes, what is the page's own stays. A
page that has no line of its own beside the other, or leaves it none, is a copy, not another page of the site, and one
that shares nothing is of another make: the next one is taken. If more than `MUCH` of the lines are shared, they go only if the next nearest page shares them too.
Every page is compared, and every text comes out of the comparison. A check by the marks follows: a deleted line that the
page itself marks as its article and nothing puts in doubt is put back, as articles repeat passages of each other; on pages
with an article, lines outside it go even if they are the page's own.

Scale. Only hashes of lines are ordered and compared. Equal pages of a host are one row there. The order is a range
partitioning, so a host with a third of all pages is spread over tasks; positions in it cut the rows into blocks of
`BLOCK`, which overlap by `REACH`. Nothing but counts per partition reaches the driver. Aligning takes the product of the
two pages' lines in time, their sum in memory. Lines that the check drops anyway are not shuffled as texts.

Defined cases. Null html is empty text; null or odd urls have no neighbours. Equal urls are ordered by page_id. Repeated
rows get a row each. Truncated pages and unclosed elements are read as far as they go. Empty tables give no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Element names by what they do.
SKIP = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select option textarea dialog menu title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN_ROLES, SKIP_ROLES = frozenset(["main", "article"]), frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SKIP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related recommended recommendations pagination pager widget login".split()
)
#: Of these, names of things that no other word beside them turns into article text.
DROP_NAMES = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion comment comments commentlist disqus reply replies cookie cookies consent notice notices popup modal newsletter subscribe signup breadcrumb breadcrumbs navbar pagination login".split())
#: Words that make a name say something about an element that holds or lacks such a thing.
FLAG_NAMES = frozenset("has no with without is not open closed status allow enabled disabled hide count".split())
#: Names that say where an element stands, not what it is.
FRAME_NAMES = frozenset("area bar block body bottom box button buttons cell col column container content first group header holder icon inner item items last left link links list main outer page panel post posts right row section side site slot top unit wrap wrapper".split())
MAIN_NAMES = frozenset("articlebody article-body entry-content post-content article-content main-content".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


OUTSIDE, INSIDE, DOUBTFUL = range(3)


@lru_cache(maxsize=4096)
def named(value: str) -> tuple[bool, bool, bool, bool]:
    """Whether the names of a class or id attribute stand for something that is never article text, for such a thing
    unless the element is the article itself, perhaps for such a thing, and for the article. Numbers in names say nothing."""
    skip = drop = doubt = main = False
    for v in value.split():
        parts = {p for p in re.split("[_-]+", v) if p and not re.fullmatch(r"\d+(x\d+)?", p)}
        main |= v in MAIN_NAMES
        if v in SKIP_NAMES or (parts & SKIP_NAMES and parts <= SKIP_NAMES | FRAME_NAMES):
            skip = True
        elif parts & DROP_NAMES and not parts & FLAG_NAMES:
            drop = True
        elif parts & SKIP_NAMES:
            doubt = True
    return skip, drop, doubt, main


def kind(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Whether an element is never article text, whether that is doubtful, and whether it is the article."""
    skip, doubt, main = tag in SKIP or (tag == "header" and not in_main), False, tag in ("article", "main")
    drop = False
    if attrs:
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                a, b, c, d = named(value)
                skip, drop, doubt, main = skip | a, drop | b, doubt | c, main | d
            elif name == "role":
                skip, main = skip or value in SKIP_ROLES, main or value in MAIN_ROLES
            elif name == "itemprop":
                main |= value == "articlebody"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                skip = True
    whole = tag in ("html", "body")
    return skip or (drop and not main and not whole), doubt and not whole, main


def page_lines(html: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page outside elements that are never text, and the mark of each."""
    lines: list[str] = []
    marks: list[int] = []
    if not html:
        return lines, marks
    top = (False, False, False)  # skipped, in the article, doubtful there
    stack: list[tuple[str, tuple[bool, bool, bool]]] = []
    parts: list[str] = []
    skip, main, doubt = top
    at = 0

    def flush():
        if parts:
            line = " ".join("".join(parts).split())
            parts.clear()
            if line:
                lines.append(line)
                marks.append(DOUBTFUL if doubt else INSIDE if main else OUTSIDE)

    def text(s: str):
        if s and not skip:
            parts.append(unescape(s) if "&" in s else s)

    while True:
        m = TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br" and not skip:
            parts.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            skip, main, doubt = stack[-1][1] if stack else top
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "body" or (tag in ("p", "li") and any(s[0] == tag for s in stack[-4:])):  # closed by what follows
            end = "head" if tag == "body" else tag
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == end:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
            skip, main, doubt = stack[-1][1] if stack else top
        a, b, c = kind(tag, m[3], main)
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(html, at)
            at = close.start() if close else len(html)
        skip, doubt, main = skip or a, doubt or (b and main), main or c
        stack.append((tag, (skip, main, doubt)))
    flush()
    return lines, marks


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (lower case, no port) and path; a url without a host has none."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)", url or "")
    return (m[1].lower(), m[2] or "/") if m else ("", "")


def hashes(lines: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(x.encode()) >> 1 for x in lines]


#: Cells of an alignment that are kept at once; beyond, it is halved.
CELLS = 1 << 20


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of `x` with each prefix of `y`."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def _common(x: np.ndarray, y: np.ndarray, base: int, out: np.ndarray) -> None:
    """Marks in `out`, from `base` on, the items of `x` in a longest common subsequence with `y`: by halves of `x`, in
    memory for one row, down to tables of `CELLS`."""
    if not len(x) or not len(y):
        return
    if len(x) == 1:
        out[base] = bool((y == x[0]).any())
        return
    if (len(x) + 1) * (len(y) + 1) > CELLS:
        mid = len(x) // 2
        cut = int((_lengths(x[:mid], y) + _lengths(x[mid:][::-1], y[::-1])[::-1]).argmax())
        _common(x[:mid], y[:cut], base, out)
        _common(x[mid:], y[cut:], base + mid, out)
        return
    rows = np.zeros((len(x) + 1, len(y) + 1), np.int32)  # rows[i]: lengths for the suffix from i
    for i in range(len(x) - 1, -1, -1):
        hit = np.concatenate([np.where(y == x[i], rows[i + 1, 1:] + 1, 0), [0]])
        rows[i] = np.maximum.accumulate(np.maximum(rows[i + 1], hit)[::-1])[::-1]
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out[base + i] = True
            i, j = i + 1, j + 1
        elif rows[i, j + 1] >= rows[i + 1, j]:
            j += 1
        else:
            i += 1


def shared(a, b) -> np.ndarray:
    """Which items of `a` belong to a longest common subsequence with `b`."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    out = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    lo = int(differs[0]) if len(differs) else n
    differs = np.flatnonzero(a[lo:][::-1][: n - lo] != b[lo:][::-1][: n - lo])
    tail = int(differs[0]) if len(differs) else n - lo
    out[:lo] = out[len(a) - tail :] = True
    x, y = a[lo : len(a) - tail], b[lo : len(b) - tail]
    y = y[np.isin(y, x)]
    own = np.flatnonzero(np.isin(x, y))
    found = np.zeros(len(own), bool)
    _common(x[own], y, 0, found)
    out[lo + own[found]] = True
    return out


def prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


#: Pages on either side that may be a page's neighbour; rows of a block.
REACH, BLOCK = 4, 64
#: Beyond this part of its lines what a page shares with its neighbour must be shared with the next one too.
MUCH = 0.5


def deleted(path: str, own: list[int], near: list[tuple[str, int, list[int]]]) -> list[bool]:
    """Which of a page's lines the differencing deletes. `near` has the path, the distance (negative before the
    page) and the line hashes of the other pages of the host around it."""
    found = None
    for _, _, other in sorted(near, key=lambda n: (-prefix(path, n[0]), abs(n[1]), n[1])):
        now = shared(own, other)
        if now.all() or now.sum() == len(other) or not now.any():  # a copy, or a page of another make
            continue
        if found is not None:
            found &= now
            break
        found = now
        if found.sum() <= MUCH * len(own):
            break
    return [False] * len(own) if found is None else found.tolist()


def decided(parsed: DataFrame) -> DataFrame:
    """host, content, gone (for each line whether it is deleted) of every distinct page of a host that has lines."""
    import pyarrow as pa

    one = parsed.where("host <> '' and size(lines) > 0").groupBy("host", "content")
    pages = one.agg(F.min(F.struct("path", "page_id")).alias("first"), F.min("lines").alias("lines"))
    pages = pages.select("host", "content", "first.path", "first.page_id", "lines")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "page_id", "content"]
    ranged = pages.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged.drop("page_id"))
    part = F.shiftright("at", 33).cast("int")
    before, total = {}, 0
    for r in sorted(ranged.groupBy(part.alias("part")).count().collect()):  # a count per partition
        before[r["part"]], total = total, total + r["count"]
    offsets = [before.get(k, 0) for k in range(max(before, default=-1) + 1)]
    if not offsets:
        return ranged.select("host", "content", F.array().cast("array<boolean>").alias("gone"))
    placed = ranged.withColumn("pos", F.element_at(F.lit(offsets), part + 1).cast("long") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")
    block = F.sequence(F.floor((F.greatest(F.col("pos") - REACH, F.lit(0))) / BLOCK), F.floor((F.col("pos") + REACH) / BLOCK))
    blocks = placed.withColumn("block", F.explode(block)).repartition("block").sortWithinPartitions("block", "pos")

    def solve(rows):
        for k, r in enumerate(rows):
            if r["pos"] // BLOCK == r["block"]:
                near = [o for o in rows[max(0, k - REACH) : k + REACH + 1] if o is not r and o["host"] == r["host"]]
                yield r["host"], r["content"], deleted(r["path"], r["lines"], [(o["path"], o["pos"] - r["pos"], o["lines"]) for o in near])

    def run(batches):
        held: list = []

        def flush():
            out = list(solve(held))
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.bool_())))], ["host", "content", "gone"])

        for b in batches:
            for r in b.to_pylist():
                if held and held[-1]["block"] != r["block"]:
                    yield flush()
                    held = []
                held.append(r)
        yield flush()

    return materialise(blocks.mapInArrow(run, "host string, content long, gone array<boolean>"))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text, n_deleted (lines that the differencing deleted),
    n_restored (those of them that are the article's)."""
    import pyarrow as pa
    import xxhash

    rows = pages.select("page_id", "url", "html")
    pid = rows.schema["page_id"].dataType.simpleString()
    digest = lambda h: xxhash.xxh64_intdigest(np.asarray(h, np.int64).tobytes()) >> 1

    def parse(batches):
        for b in batches:
            where = [url_parts(u) for u in b.column("url").to_pylist()]
            lines = [hashes(page_lines(h)[0]) for h in b.column("html").to_pylist()]
            cols = [pa.array([w[k] for w in where], pa.string()) for k in (0, 1)]
            cols += [pa.array([digest(h) for h in lines], pa.int64()), pa.array(lines, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *cols], ["page_id", "host", "path", "content", "lines"])

    parsed = materialise(rows.mapInArrow(parse, f"page_id {pid}, host string, path string, content long, lines array<long>"))

    def texts(batches):
        """Lines that may be text, their places and whether the page marks them as its article without doubt."""
        for b in batches:
            got = [page_lines(h) for h in b.column("html").to_pylist()]
            may = [[k for k, m in enumerate(marks) if m != OUTSIDE] or list(range(len(marks))) for _, marks in got]
            cols = [pa.array([url_parts(u)[0] for u in b.column("url").to_pylist()], pa.string()), pa.array([digest(hashes(g[0])) for g in got], pa.int64())]
            cols += [pa.array([[g[0][k] for k in at] for g, at in zip(got, may, strict=True)], pa.list_(pa.string())), pa.array(may, pa.list_(pa.int32()))]
            cols += [pa.array([[g[1][k] == INSIDE for k in at] for g, at in zip(got, may, strict=True)], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *cols], ["page_id", "url", "host", "content", "lines", "places", "inside"])

    left = rows.mapInArrow(texts, f"page_id {pid}, url string, host string, content long, lines array<string>, places array<int>, inside array<boolean>")
    left = left.join(decided(parsed), ["host", "content"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<boolean>")))
    gone = lambda place: F.coalesce(F.get("gone", place), F.lit(False))
    kept = F.filter("lines", lambda x, k: F.get("inside", k) | ~gone(F.get("places", k)))
    restored = F.filter("places", lambda at, k: F.get("inside", k) & gone(at))
    return left.select(
        "page_id", "url", F.array_join(kept, "\n").alias("text"),
        F.size(F.filter("gone", lambda g: g)).cast("long").alias("n_deleted"), F.size(restored).cast("long").alias("n_restored"),
    )


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_deleted", "n_restored")
