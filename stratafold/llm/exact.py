"""Exact deduplication with an extendible-hash index on shared files (DataFrame functions only).

Keys. Runs of white space become one space; the normalised text's 64-bit hash is its key. One pass stores an entry per
row (row, doc_id, key, bytes, digest) in the shared folder and counts the rows of each key.
Directory. A bucket is all keys with the same leading bits. Buckets whose texts exceed `capacity` bytes are overfull:
the directory doubles (one bit more) and they are split, until all fit or hold one key. The directory has one pointer per
leading bits of the global depth; it has a few entries per bucket, so it grows with bytes / capacity.
Owners. The texts are shuffled once, by bucket; one task owns a bucket, so a range of keys. It chains the texts of
equal keys in order of their bytes: a chain's rows with equal bytes are one group, however many texts collide on a key.

Skew. Keys with more than `HOT` rows (at most `MOST_HOT` of them: the threshold rises until so few are left) do not
travel row by row. Their texts are compared after a map-side combination, one row per task and text; the groups found
meet the stored entries by a broadcast of that bounded number of rows. Hot keys on which different texts collide, which
64-bit keys practically exclude, take the owners' way, so that bytes decide there, too.

Scale. Texts are read three times (keys, hot texts, owners) and shuffled once; that shuffle carries also texts that
turn out to be unique. All else moves under 150 bytes a row. The directory is broadcast up to `MOST_SLOTS` entries.

Defined cases. Null text is the empty text. A null doc_id is larger than any other; of rows with equal ids and texts
exactly one stays. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

#: Bytes of text that a bucket may hold: a 2^18th of all, at least `CAPACITY`, so that the directory stays short. How many
#: bits the directory may grow beyond its first estimate: texts larger than the capacity cannot be parted any better.
CAPACITY, MOST_BUCKETS, MORE_BITS = 8 << 20, 1 << 18, 4
#: Rows of a key from which it is hot, hot keys and directory entries that are broadcast at most.
HOT, MOST_HOT, MOST_SLOTS = 32, 100_000, 1 << 21
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def key_of(norm, bits: int):
    """The key: the first `bits` bits of the text's hash, the others zero. All 64 in production; tests make texts collide."""
    key = F.xxhash64(norm)
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def leading(key, depth: int):
    """The first `depth` bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket) for each value of a key's first `depth` bits, and the global depth. `keys` has key and load (bytes).
    A bucket's name is its first slot's place among all keys: names order as key ranges."""
    spark = keys.sparkSession
    total = keys.agg(F.sum("load")).first()[0] or 0
    capacity = max(capacity, total // MOST_BUCKETS)
    first = depth = max(0, int(2 * total // capacity).bit_length())
    live, leaves = keys, []
    while True:
        counted = live.groupBy(leading(F.col("key"), depth).alias("slot")).agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("keys"))
        counted = materialise(counted)
        fits = (F.col("load") <= capacity) | (F.col("keys") == 1)
        done = depth >= min(63, first + MORE_BITS) or not counted.where(~fits).limit(1).count()
        leaves.append((depth, counted if done else counted.where(fits)))
        if done:
            break
        over = counted.where(~fits).select("slot")
        live = live.join(F.broadcast(over) if over.count() <= MOST_SLOTS else over, leading(F.col("key"), depth) == over["slot"], "left_semi")
        depth += 1  # the directory doubles
    out = spark.createDataFrame([], "slot long, bucket long")
    for d, leaf in leaves:
        shift = depth - d
        own = leaf.select(F.explode(F.sequence(F.shiftleft("slot", shift), F.shiftleft(F.col("slot") + 1, shift) - 1)).alias("slot"), F.shiftleft("slot", shift).alias("bucket"))
        out = out.unionByName(own)
    return materialise(out), depth


def hot_keys(keys: DataFrame, hot: int = HOT, most: int = MOST_HOT) -> DataFrame:
    """key, n of the keys with the most rows: all with more than a threshold, `hot` at least, that leaves `most` keys."""
    level = F.floor(F.log2("n") * 4).cast("int")
    counts = keys.where(F.col("n") > hot).groupBy(level.alias("level")).count().collect()
    taken, least = 0, None
    for r in sorted(counts, key=lambda r: -r["level"]):
        taken += r["count"]
        if taken > most:
            break
        least = r["level"]
    return keys.where((F.col("n") > hot) & (level >= least)).select("key", "n") if least is not None else keys.where("false").select("key", "n")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, hot: int = HOT, most_hot: int = MOST_HOT, bits: int = 64) -> DataFrame:
    """docs (doc_id, text) to doc_id, keep_id, group_size, kept, text_sha256, bucket: one row per row of `docs`."""
    docs = docs.select("doc_id", "text")
    whole = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    whole = whole.select("doc_id", "norm", key_of(F.col("norm"), bits).alias("key"))
    entries = materialise(
        whole.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.octet_length("norm").cast("long").alias("bytes"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    )
    keys = materialise(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes") + 64).alias("load")))

    hot_ = materialise(hot_keys(keys, hot, most_hot))
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    texts = whole.join(F.broadcast(hot_.select("key")), "key", "left_semi").groupBy("key", "norm").agg(F.count(F.lit(1)).alias("size"))
    single = texts.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.max("size").alias("group_size")).where("texts = 1").drop("texts")
    first = entries.join(F.broadcast(hot_.select("key")), "key", "left_semi").groupBy("key").agg(F.min(name).alias("first"))
    groups = materialise(single.join(first, "key").select("key", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")))
    apart = F.broadcast(groups)  # at most MOST_HOT rows of 32 bytes

    slots, depth = directory(keys.join(apart, "key", "left_anti"), capacity)
    slots_ = F.broadcast(slots) if slots.count() <= MOST_SLOTS else slots
    held = whole.join(F.broadcast(groups.select("key")), "key", "left_anti").withColumn("slot", leading(F.col("key"), depth)).join(slots_, "slot")
    owned = held.select("bucket", "key", "norm", "doc_id").repartition("bucket")  # a bucket's owner is one task
    chain = Window.partitionBy("bucket", "key", "norm")
    order = chain.orderBy(F.col("doc_id").asc_nulls_last())
    cold = owned.select(
        "doc_id", F.min("doc_id").over(chain).alias("keep_id"), F.count(F.lit(1)).over(chain).alias("group_size"), (F.row_number().over(order) == 1).alias("kept"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "bucket",
    )
    warm = entries.join(apart, "key").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", F.lit(None).cast("long").alias("bucket"))
    out = materialise(cold.unionByName(warm))
    discard(entries)
    return out


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document's group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("bucket")


OP11_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from n
"""
