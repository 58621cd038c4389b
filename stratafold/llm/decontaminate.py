"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only).

Index. Texts are cut into words once; every occurrence of a word that the benchmark uses is a posting (document row,
term, position), stored as Parquet in the shared folder. A document's end is a posting of the empty term: its position
is the number of words, and it carries the document's id and text hash.
Search. The benchmark is cut into windows of `window` consecutive words, whose terms are ordered by the lengths of their
posting lists, rarest first. A posting of the rarest term, shifted by its offset, proposes a start of the window in a
document; the starts are intersected with the second list, shifted by its own offset, and what is left with all others.

Scale. Postings stay in the order of the documents; only the lists of the two rarest terms of each window and the
starts they propose are shuffled, by (document, position), which no frequent word makes hot. The places that the
surviving starts ask for, each once, meet the whole index by a broadcast if they are at most `BROADCAST_ROWS`, else by a
shuffle on the same key. Terms and windows are broadcast if the benchmark holds at most `broadcast_words` words, beyond
that they are joined by shuffles. The whole index is read four times: for the lists' lengths, for the short lists, for
the places and for the documents' ends.

Defined cases. Null and empty texts have no words. Items with fewer than `window` words (not none) are one window.
Null item ids are ignored. Repeated document rows get one result each; rows that share an id but not a text are told
apart by the text's hash. Empty tables give empty or clean results. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialise, table

#: Benchmarks with more words than this are joined by shuffles rather than broadcast; so are more places than this.
BROADCAST_WORDS, BROADCAST_ROWS = 200_000, 1_000_000
WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term whose posting ends a document.
END = 0


def words(col):
    """The words of a text as an array: maximal runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased first."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(col), F.lit("")), SEPARATORS), "")


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


class Index:
    """The stored postings of all words that `benchmark` uses: `postings` (row, term, pos, doc_id, text_key; the last two
    for ends only), `short` (row, term, pos: the lists of the two rarest terms of each window),
    `terms` (word, term) and `windows` (win, items ARRAY<STRING>, lists ARRAY<STRUCT<n, off, term>>
    rarest first); windows with a word that the corpus lacks occur nowhere and are left out."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS):
        items = materialise(benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0"))
        self.small = (items.select(F.sum(F.size("w")).alias("n")).first()["n"] or 0) <= broadcast_words
        used = items.select(F.explode("w").alias("word")).distinct()
        self.terms = materialise(used.withColumn("term", F.monotonically_increasing_id() + 1).unionByName(docs.sparkSession.createDataFrame([("", END)], "word string, term long")))
        doc = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
        post = doc.select("row", "doc_id", "text_key", F.posexplode("w").alias("pos", "word")).join(_hint(self.terms, self.small), "word")
        end = F.col("term") == END
        self.postings = materialise(post.select("row", "term", "pos", F.when(end, F.col("doc_id")).alias("doc_id"), F.when(end, F.col("text_key")).alias("text_key")))
        counts = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        cut = items.select("item", "w", F.explode(F.expr(f"sequence(1, greatest(1, size(w) - {window - 1}))")).alias("s"))
        wins = cut.groupBy(F.expr(f"slice(w, s, {window})").alias("words")).agg(F.array_sort(F.collect_set("item")).alias("items"))
        wins = materialise(wins.withColumn("win", F.monotonically_increasing_id()))
        placed = wins.select("win", F.posexplode("words").alias("off", "word")).join(_hint(self.terms, self.small), "word").join(_hint(counts, self.small), "term")
        lists = placed.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("lists"))
        self.windows = materialise(wins.join(lists, "win").where("size(lists) = size(words)").select("win", "items", "lists"))
        heads = self.windows.select(F.explode(F.slice("lists", 1, 2)).alias("x")).select("x.term").distinct()
        self.short = materialise(self.words_at().join(_hint(heads, self.small), "term", "left_semi").select("row", "term", "pos"))

    def documents(self) -> DataFrame:
        """row, doc_id, text_key, n_words of every document."""
        return self.postings.where(F.col("term") == END).select("row", "doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))

    def words_at(self) -> DataFrame:
        return self.postings.where(F.col("term") != END).select("row", "term", "pos")

    def rarest(self) -> DataFrame:
        """row, win, start, size: the starts that postings of each window's rarest term propose."""
        first = self.windows.select("win", F.col("lists")[0]["term"].alias("term"), F.col("lists")[0]["off"].alias("off"), F.size("lists").alias("size"))
        return self.short.join(_hint(first, self.small), "term").where("pos >= off").select("row", "win", (F.col("pos") - F.col("off")).alias("start"), "size")

    def phrases(self) -> DataFrame:
        """row, win, start, size: exact occurrences, by intersection of the shifted lists from the rarest on."""
        second = self.windows.where("size(lists) > 1").select("win", F.col("lists")[1]["term"].alias("term"), F.col("lists")[1]["off"].alias("off"))
        seeds = self.rarest()
        asked = seeds.where("size > 1").join(_hint(second, self.small), "win").select("row", "win", "start", "size", "term", (F.col("start") + F.col("off")).alias("pos"))
        left = materialise(asked.join(self.short, ["row", "pos", "term"]).select("row", "win", "start", "size").unionByName(seeds.where("size = 1")))
        others = self.windows.select("win", F.inline(F.slice("lists", 3, F.greatest(F.size("lists") - 2, F.lit(0))))).select("win", "off", "term")
        asked = left.where("size > 2").join(_hint(others, self.small), "win").select("row", "win", "start", "size", "term", (F.col("start") + F.col("off")).alias("pos"))
        places = materialise(asked.select("row", "pos", "term").distinct())  # overlapping windows ask for the same ones
        few = places.count() <= BROADCAST_ROWS
        met = self.words_at().join(F.broadcast(places) if few else places.hint("shuffle_hash"), ["row", "pos", "term"])
        whole = asked.join(met, ["row", "pos", "term"]).groupBy("row", "win", "start", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size - 2").drop("n")
        return whole.unionByName(left.where("size <= 2"))

    def close(self) -> None:
        """Frees the stored postings; results must have been written before."""
        discard(self.postings)


def phrase_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_key, n_words) of every document, and exact phrase matches (row, s, e, items), e exclusive."""
    index = Index(docs, benchmark, window, broadcast_words)
    found = index.phrases().join(_hint(index.windows.select("win", "items"), index.small), "win")
    found = materialise(found.select("row", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"), "items"))
    every = materialise(index.documents())
    index.close()
    return every, found


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key of the documents with an exact match."""
    every, hits = phrase_hits(docs, benchmark, window)
    return every.join(hits.select("row").distinct(), "row", "left_semi").select("doc_id", "text_key").distinct()


def proximity_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 5, broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """Proximity matches: doc_id, text_key, item_id, pos where all of a window's words lie within `window + slop` words
    on each side of its rarest term at `pos`, in any order. Every exact phrase is also a proximity match."""
    index, reach = Index(docs, benchmark, window, broadcast_words), window + slop
    wins = index.windows.select("win", F.col("lists")[0]["off"].alias("off"), F.array_distinct(F.transform("lists", lambda x: x["term"])).alias("terms"))
    seeds = index.rarest().join(_hint(wins, index.small), "win").select("row", "win", (F.col("start") + F.col("off")).alias("at"), "terms")
    seeds = seeds.unionByName(_early(index, wins)).distinct()
    cell = F.floor(F.col("at") / reach)
    asked = seeds.select("row", "win", "at", F.size("terms").alias("size"), F.explode("terms").alias("term"), F.array(cell - 1, cell, cell + 1).alias("cells"))
    asked = asked.withColumn("cell", F.explode("cells")).drop("cells")
    met = index.words_at().withColumn("cell", F.floor(F.col("pos") / reach)).join(asked, ["row", "cell", "term"]).where(f"abs(pos - at) < {reach}")
    whole = met.groupBy("row", "win", "at", "size").agg(F.count_distinct("term").alias("n")).where("n = size")
    found = whole.join(index.windows.select("win", F.explode("items").alias("item_id")), "win").select("row", "item_id", F.col("at").alias("pos")).distinct()
    return found.join(index.documents(), "row").select("doc_id", "text_key", "pos", "item_id")


def _early(index: Index, wins: DataFrame) -> DataFrame:
    """Postings of rarest terms too near a text's front for an exact match."""
    first = index.windows.select("win", F.col("lists")[0]["term"].alias("term")).join(wins, "win")
    return index.short.join(_hint(first, index.small), "term").where("pos < off").select("row", "win", F.col("pos").alias("at"), "terms")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, items (sorted strings), contaminated."""
    every, hits = phrase_hits(docs, benchmark, window, broadcast_words)
    covered = """aggregate(array_sort(hits), struct(cast(0 as bigint) as n, -1 as top),
        (a, h) -> struct(a.n + greatest(0, h.e - greatest(h.s, a.top)) as n, greatest(a.top, h.e) as top), a -> a.n)"""
    one = hits.groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("hits"), F.collect_set("items").alias("items"))
    found = one.select("row", F.expr(covered).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    return every.join(found, "row", "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document against every benchmark item."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP7_SQL = r"""
with bw as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
win as (select distinct item_id, w[s:s + 9] as terms from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as s from bw where len(w) > 0)),
first_word as (select distinct terms[1] as f, len(terms) as n from win),
dw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from dw),
cand as (select doc_id, p, n, w[p:p + n - 1] as terms from pos join first_word on w[p] = f),
hit as (select doc_id, p, n, item_id from cand join win using (terms)),
covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""
