"""Ordered sequences from fact and event tables.

A sequence table has seq_id, idx (1..n without gaps), x, y and optionally w, a (likelihood power; 0 hides a row),
n_trials, r, phi, channel, label. Buckets are aggregated map-side before any shuffle; only buckets reach a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULTS = {"w": 1.0, "a": 1.0, "n_trials": 1.0, "r": 1.0, "phi": 1.0}


def indexed(df: DataFrame, order: list, by: str = "seq_id") -> DataFrame:
    """Adds idx by `order`, which must end in a unique key, and x = idx if there is none."""
    out = df.withColumn("idx", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("int"))
    return out if "x" in df.columns else out.withColumn("x", F.col("idx").cast("double"))


def complete(df: DataFrame) -> DataFrame:
    """Fills absent descriptor columns with their defaults, casts to double and checks what can be checked per row."""
    for name, value in DEFAULTS.items():
        df = df.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(value)) if name in df.columns else F.lit(value))
    if "observed" in df.columns:
        df = df.withColumn("a", F.when(F.coalesce("observed", F.lit(True)), F.col("a")).otherwise(0.0))
        bad = F.isnan("y") | F.col("y").isNull() | (F.abs("y") == float("inf"))
        df = df.withColumn("y", F.when((F.col("a") == 0) & bad, 0.0).otherwise(F.col("y"))).withColumn("w", F.when((F.col("a") == 0) & (F.isnan("w") | (F.col("w") < 0)), 1.0).otherwise(F.col("w")))
    return df.select("seq_id", "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *DEFAULTS, *[c for c in ("channel", "label") if c in df.columns])


def violations(df: DataFrame) -> DataFrame:
    """Per sequence what the engine would reject: non-finite values, negative weights, unordered x, gaps in idx."""
    by = Window.partitionBy("seq_id").orderBy("idx")
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    d = df.withColumn("dx", F.col("x") - F.lag("x").over(by))
    n = lambda c, name: F.count_if(c).alias(name)
    return d.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n"), n(odd("x") | odd("y"), "n_not_finite"), n(F.col("w") < 0, "n_negative_weight"),
        n(F.col("dx") <= 0, "n_unordered"), (F.max("idx") - F.count(F.lit(1))).cast("long").alias("n_gaps"),
    )


def bucketed(df: DataFrame, key: Column, at: Column, y: Column, w: Column | None = None, **more: Column) -> DataFrame:
    """One row per (key, bucket) with aggregates y, w and more, in bucket order."""
    agg = [y.alias("y"), *([w.alias("w")] if w is not None else []), *(c.alias(k) for k, c in more.items())]
    return indexed(df.groupBy(key.cast("string").alias("seq_id"), at.alias("bucket")).agg(*agg), ["bucket"])


def events_daily(events: DataFrame) -> DataFrame:
    return bucketed(events, F.col("event_type"), F.date_trunc("day", "ts"), F.count(F.lit(1)).cast("double"))


def events_value_daily(events: DataFrame) -> DataFrame:
    return bucketed(events, F.col("event_type"), F.date_trunc("day", "ts"), F.avg("value"), F.count(F.lit(1)).cast("double"))


def error_rate_daily(events: DataFrame) -> DataFrame:
    errors = F.count_if(F.col("event_type") == "error").cast("double")
    return bucketed(events, F.lit("all"), F.date_trunc("day", "ts"), errors, n_trials=F.count(F.lit(1)).cast("double"))


def shipments_monthly(lineitem: DataFrame) -> DataFrame:
    return bucketed(lineitem, F.col("l_returnflag"), F.date_trunc("month", "l_shipdate"), F.count(F.lit(1)).cast("double"))


def discount_monthly(lineitem: DataFrame) -> DataFrame:
    return bucketed(lineitem, F.col("l_returnflag"), F.date_trunc("month", "l_shipdate"), F.avg("l_discount") * 10, phi=F.count(F.lit(1)).cast("double"))


def orders_monthly(orders: DataFrame) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F").cast("double")
    return bucketed(orders, F.col("o_orderpriority"), F.date_trunc("month", "o_orderdate"), done, n_trials=F.count(F.lit(1)).cast("double"))


def labels_binary(labels: DataFrame) -> DataFrame:
    """The labels in document order as 0/1 sequences."""
    both = labels.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("seq_id"), F.col("quality").alias("y")), F.struct(F.lit("toxic").alias("seq_id"), F.col("toxic").alias("y")))).alias("s"))
    return indexed(both.select("s.seq_id", F.col("s.y").cast("double").alias("y"), "doc_id"), ["doc_id"])


def user_values(events: DataFrame) -> DataFrame:
    """Irregular sequences: one per user, x in hours, y the log value."""
    e = events.where("value > 0").select(F.col("user_id").cast("string").alias("seq_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.log("value").alias("y"))
    return indexed(e.withColumn("x", F.col("us") / 3.6e9), ["us", "event_id"])


def quantity_channels(lineitem: DataFrame) -> DataFrame:
    """One monthly sequence with three standardised-scale channels, long."""
    m = indexed(lineitem.groupBy(F.lit("all").alias("seq_id"), F.date_trunc("month", "l_shipdate").alias("bucket")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"), F.avg("l_discount").alias("d")), ["bucket"])
    wide = F.array(F.col("q"), F.col("p") / 1000, F.col("d") * 100)
    return m.select("seq_id", "idx", "x", F.posexplode(wide).alias("channel", "y"))


def bounds(seq: DataFrame) -> DataFrame:
    """Boundary coordinates u at positions 0..n: midpoints, end caps of half the adjacent gap, +-1/2 around a single point."""
    by = Window.partitionBy("seq_id").orderBy("idx")
    d = seq.select("seq_id", "idx", "x", F.lag("x").over(by).alias("p"), F.lead("x").over(by).alias("q"))
    right = F.when(F.col("q").isNotNull(), (F.col("x") + F.col("q")) / 2).otherwise(F.col("x") + F.coalesce((F.col("x") - F.col("p")) / 2, F.lit(0.5)))
    left = F.col("x") - F.coalesce((F.col("q") - F.col("x")) / 2, F.lit(0.5))
    inner = d.select("seq_id", F.col("idx").alias("pos"), right.alias("u"))
    return inner.unionByName(d.where("idx = 1").select("seq_id", F.lit(0).alias("pos"), left.alias("u")))


def rolling_mad(seq: DataFrame, half: int = 10) -> DataFrame:
    """Centred rolling scale: max(1.4826 * median |v - median|, 1e-3)."""
    by = Window.partitionBy("seq_id").orderBy("idx").rowsBetween(-half, half)
    d = seq.withColumn("near", F.array_sort(F.collect_list("y").over(by)))
    med = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)) / 2
    d = d.withColumn("m", med(F.col("near"))).withColumn("dev", F.array_sort(F.transform("near", lambda v: F.abs(v - F.col("m")))))
    return d.select("seq_id", "idx", F.greatest(1.4826 * med(F.col("dev")), F.lit(1e-3)).alias("mad"))


def mad_weights(seq: DataFrame, half: int = 10) -> DataFrame:
    """Precision weights (median scale / scale)^2 from the rolling scale."""
    m = rolling_mad(seq, half)
    mid = m.groupBy("seq_id").agg(F.median("mad").alias("mid"))
    return seq.join(m, ["seq_id", "idx"]).join(mid, "seq_id").withColumn("w", F.pow(F.col("mid") / F.col("mad"), 2)).drop("mad", "mid")


def log_squared_change(seq: DataFrame) -> DataFrame:
    """log(r^2 + 1e-12) of log returns r of positive y."""
    by = Window.partitionBy("seq_id").orderBy("idx")
    d = seq.withColumn("r", F.log("y") - F.log(F.lag("y").over(by))).where("r is not null")
    return d.select("seq_id", (F.col("idx") - 1).alias("idx"), "x", F.log(F.col("r") * F.col("r") + 1e-12).alias("y"))


def subsample(seq: DataFrame, stride: int) -> DataFrame:
    return seq.where((F.col("idx") - 1) % stride == 0).withColumn("idx", (F.floor((F.col("idx") - 1) / stride) + 1).cast("int"))


def remap_boundary(b: Column, stride: int) -> Column:
    """A boundary's place after `subsample`: the kept rows before it."""
    return F.ceil(b / stride)


def content_hash(seq: DataFrame) -> DataFrame:
    """SHA-256 per sequence over its rows in order."""
    one = seq.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(":", F.col("idx").cast("string"), F.format_string("%.9f", "y")).alias("s")))).alias("v"))
    return one.select("seq_id", F.sha2(F.concat_ws(",", F.col("v.s")).cast("binary"), 256).alias("sha256"))


def digest(seq: DataFrame, columns: list[str], chunk: int = 4096) -> str:
    """SHA-256 of a whole sequence table in order of (seq_id, channel, idx): rows are hashed in chunks, chunks in sequences,
    so no task holds more than a chunk's rows or a sequence's chunk digests. The text of a double is exact."""
    by = ["seq_id", *(["channel"] if "channel" in seq.columns else [])]
    row = F.struct("idx", F.concat_ws(":", F.col("idx").cast("string"), *[F.coalesce(F.col(c).cast("double").cast("string"), F.lit("null")) for c in columns]).alias("s"))
    sha = lambda rows: F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(rows))["s"]).cast("binary"), 256)
    part = seq.groupBy(*by, F.floor(F.col("idx") / chunk).alias("c")).agg(sha(row).alias("h"))
    one = part.groupBy(*by).agg(sha(F.struct("c", F.col("h").alias("s"))).alias("h"))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in by])
    slot = F.substring("h", 1, 2)  # 256 groups of sequences
    few = one.groupBy(slot.alias("c")).agg(sha(F.struct(key.alias("k"), F.concat_ws("=", key, F.col("h")).alias("s"))).alias("h"))
    return few.agg(sha(F.struct("c", F.col("h").alias("s")))).first()[0]
