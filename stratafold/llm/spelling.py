"""Spelling variants by anagram hashing.

Words are counted over all texts. A word's anagram value is the sum of a power of each of its letters, a whole number
that its letters fix, whatever their order. Two words one edit apart have values that differ by one letter's value
(addition, removal) or by the difference of two (exchange). So each word is entered under its value less each of its
letters, and under its value itself: equal entries are the words that any one-letter removal or exchange connects. An
edit leaves the first or the second half of a word as it is; entries carry the half that stays, so that only words that
also agree in it meet. The order of the letters is then verified.

A word's form is the most frequent of its near words if that is at least `RATIO` times as frequent. Forms lead to forms;
roots are found by doubling: after k rounds a word has followed 2^k forms.

Scale. Occurrences are combined map-side before they are shuffled, so no word is hot; all else grows with the distinct
words of `LEAST` occurrences: some 10 narrow entries a word, joined on a 64-bit key. A word has at most 91 near words per
place, so pairs grow with the words. Rounds are written to the shared folder.

Defined cases. Null and empty texts have no words. A null doc_id counts as the empty string in the checksum. Repeated
rows count each. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, table
from .runs import CRC_SQL, crc_sql

#: Code points and occurrences that a word has at least; how much more frequent its form is at least.
LENGTH, LEAST, RATIO = 6, 5, 5
#: One run in so many loses a letter before it is counted.
LOSES = 199
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
#: Anagram values: the power of a letter's code point, and the modulus that keeps sums of very long words in range.
POWER, MODULUS = 5, (1 << 61) - 1


def word_counts(docs: DataFrame, length: int = LENGTH, least: int = LEAST, loses: int = LOSES) -> DataFrame:
    """word, n of the words of `docs` (doc_id, text). A run of letters loses one letter if `loses` divides the checksum of
    id and run (never if it is 0)."""
    runs = F.explode(F.split(lower_ascii(F.coalesce("text", F.lit(""))), NOT_LETTERS)).alias("word")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs).where(F.char_length("word") >= length)
    if loses:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % loses == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.where(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def letter_value(letter):
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def anagram_value(letters):
    """The sum of the letters' values; `letters` is an array of single letters."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: (a + letter_value(x)) % MODULUS)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: the unordered pairs of `words` (word) that differ by exactly one inserted, deleted or replaced letter."""
    w = words.select("word").withColumn("size", F.char_length("word")).withColumn("value", anagram_value(F.split("word", "")))
    half = F.floor(F.col("size") / 2).cast("int")
    head, tail = F.substring("word", F.lit(1), half), F.substring("word", half + 1, F.col("size"))
    sides = F.array(F.struct(F.lit(0).alias("side"), head.alias("stays"), tail.alias("changes")), F.struct(F.lit(1).alias("side"), tail.alias("stays"), head.alias("changes")))
    less = F.explode(F.array_distinct(F.transform(F.split("s.changes", ""), lambda x: (F.col("value") - letter_value(x) + MODULUS) % MODULUS))).alias("rest")
    key = F.xxhash64("size", "s.side", "s.stays", "rest").alias("key")
    entries = w.select("word", "size", "value", F.explode(sides).alias("s")).select("word", "size", "s", less).select("word", "size", key)

    # the word itself, as what a longer word leaves when it loses a letter of its first or its second half
    longer = F.col("size") + 1
    half = F.floor(longer / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("stays")), F.struct(F.lit(1).alias("side"), F.substring("word", half, longer).alias("stays")))
    key = F.xxhash64(longer, "s.side", "s.stays", F.col("value").alias("rest")).alias("key")
    own = w.select("word", "size", "value", F.explode(sides).alias("s")).select(F.col("word").alias("other"), key)

    entries = materialise(entries)
    exchanged = entries.select("key", F.col("word").alias("a")).join(entries.select("key", F.col("word").alias("b")), "key").where("a < b").select("a", "b")
    removed = entries.join(own, "key").select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b"))
    near = F.levenshtein("a", "b", 1) == 1
    return exchanged.where(near).unionByName(removed.where(near)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form: another word; no circles) to word, root: the last word that following forms leads to."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = materialise(now.join(now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not nxt.where("moved").limit(1).count():
            return nxt.select("word", "root")
        now = nxt.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """counts (word, n) to word, n, n_near, form, form_n, root; `ratio` above 1."""
    counts = materialise(counts.select("word", "n"))
    pairs = materialise(near_pairs(counts))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("word"))).alias("best")  # largest n, then smallest word
    near = both.join(counts, both["b"] == counts["word"]).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    found = counts.join(near, "word", "left").withColumn("led", F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False)))
    found = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("led"), F.col("best.word")).alias("form"), F.when(F.col("led"), -F.col("best.n")).alias("form_n")))
    return found.join(roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the words of all documents, their forms and roots."""
    return variants(word_counts(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = rf"""
with recursive {CRC_SQL},
runs as materialized (
  select doc_id, r, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as r from documents)
  where length(r) >= {LENGTH} group by doc_id, r),
hashed as (select r, k, {crc_sql("coalesce(doc_id::varchar, '') || ':' || r")} as h from runs, crc_table),
lost as (select k, case when h % {LOSES} = 0 then left(r, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word from hashed),
words as materialized (select word, sum(k)::bigint as n from lost where length(word) >= {LENGTH} group by word having sum(k) >= {LEAST}),
cuts as materialized (select distinct word, i, left(word, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
near as materialized (
  select x.word as a, y.word as b from cuts x join cuts y on x.i = y.i and x.rest = y.rest and x.word <> y.word
  union select x.word, y.word from cuts x join words y on x.rest = y.word union select y.word, x.word from cuts x join words y on x.rest = y.word),
best as (select a, count(*) as n_near, arg_min({{'w': b, 'n': n}}, {{'n': -n, 'w': b}}) as m from near join words on b = word group by a),
formed as materialized (
  select word, n, coalesce(n_near, 0) as n_near, case when m.n >= {RATIO} * n then m.w end as form, case when m.n >= {RATIO} * n then m.n end as form_n
  from words left join best on word = a),
followed as (
  select word, word as root, form as further from formed
  union all select f.word, g.word, g.form from followed f join formed g on f.further = g.word)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join followed r on f.word = r.word and r.further is null
"""
