"""Readers of the dataset formats, simulators of their shapes, and the record sink.

Readers keep rows that parse and drop the rest, as distributed scans. `load` takes the simulated shape instead of a file
with too few of them, and its card says so.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequences import digest, indexed, mad_weights, rolling_mad

#: Rows that a file of plain values needs to count as a dataset.
LEAST = 50


def read_values(spark: SparkSession, path: str, name: str = "values") -> DataFrame:
    """One number per line in file order; other lines and non-finite numbers are dropped."""
    t = spark.read.text(path).select(F.expr("try_cast(trim(value) as double)").alias("y"), F.monotonically_increasing_id().alias("at"))
    t = t.where("y is not null and not isnan(y) and abs(y) < double('infinity')")
    return indexed(t.withColumn("seq_id", F.lit(name)), ["at"]).select("seq_id", "idx", "x", "y")


def read_json_values(spark: SparkSession, path: str, name: str = "values") -> DataFrame:
    """A flat list, or {"series": [{"raw": [...]}]}."""
    raw = spark.read.text(path, wholetext=True)
    deep = F.from_json("value", "struct<series:array<struct<raw:array<double>>>>")["series"][0]["raw"]
    v = raw.select(F.posexplode(F.coalesce(deep, F.from_json("value", "array<double>"))).alias("at", "y")).where("y is not null and not isnan(y)")
    return indexed(v.withColumn("seq_id", F.lit(name)), ["at"]).select("seq_id", "idx", "x", "y")


def _finite(text) -> object:
    """A number, or null if the text is none or not finite (Spark holds NaN to be greater than all numbers)."""
    v = text.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether the first line names the columns coverage and freqC, in any case."""
    head = spark.read.text(path).first()
    return bool(head) and all(name in head[0].lower() for name in ("coverage", "freqc"))


def read_methylation(spark: SparkSession, path: str) -> DataFrame:
    """A table of seven tab-separated fields (name, chr, base, strand, coverage, freqC, freqT; one sequence per chr, in
    order of base), or one fraction per line. Rows without a whole base, a positive coverage or a frequency go."""
    if not is_table(spark, path):
        return indexed(read_values(spark, path, "methylation").where("y > 0 and y < 1").drop("idx"), ["x"]).withColumn("x", F.col("idx").cast("double"))
    part = F.split(F.trim("value"), "\t")
    field = lambda k: F.trim(F.get(part, F.lit(k)))
    t = spark.read.text(path).where(F.size(part) >= 7).select(field(1).alias("seq_id"), field(2).try_cast("bigint").cast("double").alias("x"), _finite(field(4)).alias("w"), (_finite(field(5)) / 100).alias("y"))
    t = t.where("x is not null and w > 0 and y is not null").withColumn("y", F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("y"))))
    return indexed(t, ["x", "y", "w"]).select("seq_id", "idx", "x", "y", "w")


def read_probes(spark: SparkSession, path: str, name: str = "probes", individuals: list[int] | None = None) -> DataFrame:
    """Log ratios, one probe per line, weighted by rolling scale. A single column gives one sequence; a comma-separated
    matrix has a column per individual, of which `individuals` (from 0) are kept: one sequence per `channel` on a shared
    axis of the probes at which all kept cells are numbers, weighted against the median scale of all channels."""
    head = spark.read.text(path).first()
    width = len(head[0].split(",")) if head else 1
    kept = [k for k in (range(width) if individuals is None else individuals) if 0 <= k < width]
    if not kept:
        raise ValueError("none of the individuals is a column")
    if width == 1:
        return mad_weights(read_values(spark, path, name))
    part = F.split("value", ",")
    cells = F.array(*[_finite(F.trim(F.get(part, F.lit(k)))) for k in kept])
    t = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), cells.alias("v")).where(F.forall("v", lambda v: v.isNotNull()))
    t = indexed(t.withColumn("seq_id", F.lit(name)), ["at"])
    each = F.array(*[F.struct(F.lit(k).alias("channel"), F.get("v", F.lit(n)).alias("y")) for n, k in enumerate(kept)])
    long = t.select("seq_id", "idx", "x", F.inline(each)).select("seq_id", "idx", "x", "channel", "y")
    key = F.concat_ws("|", "seq_id", F.col("channel").cast("string"))
    m = rolling_mad(long.withColumn("seq_id", key)).withColumnRenamed("seq_id", "key")
    mid = m.agg(F.median("mad").alias("mid"))
    t = long.withColumn("key", key).join(m, ["key", "idx"]).join(F.broadcast(mid), F.lit(True))  # one row
    return t.select("seq_id", "idx", "x", "channel", "y", F.pow(F.col("mid") / F.col("mad"), 2).alias("w"))


#: Fixed values of the simulated shapes: the levels, the pieces' shares or lengths, noise and edge weights.
WELLLOG_LEVELS = [112.0, 115.0, 118.5, 116.2, 113.8, 119.4, 121.0, 118.1, 114.9, 117.6]
WELLLOG_SHARES = [0.08, 0.12, 0.10, 0.14, 0.09, 0.07, 0.13, 0.11, 0.08, 0.08]
CGH_PIECES = [(0.00, 380), (0.72, 85), (0.00, 210), (-0.55, 60), (0.00, 150), (0.48, 115), (0.00, 100)]
SPX_LEVELS, SPX_SHARES = [0.010, 0.028, 0.012, 0.038, 0.015], [0.28, 0.16, 0.22, 0.14, 0.20]
METHYLATION_PIECES = [(0.18, 140), (0.82, 110), (0.42, 130), (0.88, 100), (0.25, 120)]
WELLLOG_N, WELLLOG_SD, CGH_SD, CGH_EDGE, CGH_EDGE_WEIGHT, SPX_N, CONCENTRATION = 4050, 1.6, 0.18, 50, 0.6, 1500, 70.0
#: Human annotators' change points of the public well-log series, on its 675-point axis (every 6th value).
WELLLOG_ANNOTATIONS = {
    "6": (179, 255, 281, 311, 343, 402, 413, 422, 432, 462, 464),
    "7": (179, 255, 281, 312, 343, 402, 412, 422, 432),
    "8": (179, 255, 282, 312, 343, 402, 413, 422, 432),
    "12": (177, 467),
    "13": (4, 179, 255, 281, 311, 344, 402, 412, 422, 432, 462, 464, 521, 526, 620, 643, 661),
}
ANNOTATION_STRIDE = 6


def _shared_out(levels: list[float], shares: list[float], n: int) -> list[tuple[float, int]]:
    """(level, length) pieces: each share of n rounded down, the last takes the rest."""
    size = [int(s / sum(shares) * n) for s in shares[:-1]]
    return list(zip(levels, [*size, n - sum(size)], strict=True))


SHAPES = {
    "welllog": _shared_out(WELLLOG_LEVELS, WELLLOG_SHARES, WELLLOG_N),
    "cgh": CGH_PIECES,
    "spx": _shared_out(SPX_LEVELS, SPX_SHARES, SPX_N),
    "methylation": METHYLATION_PIECES,
}


def _beta_draws(seed: int):
    """Beta(c m, c (1 - m)) at level m, a generator per row, so that a task run again draws the same."""

    def draw(at: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k]).beta(CONCENTRATION * v, CONCENTRATION * (1 - v)) for k, v in zip(at, m, strict=True)], dtype=float)

    return F.pandas_udf(draw, "double")


def simulate(spark: SparkSession, shape: str, seed: int = 0) -> DataFrame:
    """A piecewise signal with noise: seq_id, idx, x, y, w and the true level, generated in parallel from the index. The
    bounded shape draws beta values of its concentration around the level."""
    pieces, expr, end = SHAPES[shape], None, 0
    for level, length in pieces:
        end += length
        expr = F.when(F.col("id") < end, F.lit(level)) if expr is None else expr.when(F.col("id") < end, F.lit(level))
    noise, m = F.randn(seed), F.col("level")
    y = {
        "welllog": m + WELLLOG_SD * noise, "cgh": m + CGH_SD * noise, "spx": F.log(F.pow(m * noise, 2) + 1e-8),
        "methylation": F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), _beta_draws(seed)("id", "level"))),
    }[shape]
    edge = (F.col("id") < CGH_EDGE) | (F.col("id") >= end - CGH_EDGE)
    w = F.when(edge, CGH_EDGE_WEIGHT).otherwise(1.0) if shape == "cgh" else F.lit(1.0)
    t = spark.range(end).withColumn("level", expr).withColumn("y", y)
    return t.select(F.lit(shape).alias("seq_id"), (F.col("id") + 1).cast("int").alias("idx"), (F.col("id") + 1.0).alias("x"), "y", w.alias("w"), "level")


def true_boundaries(shape: str, stride: int = 1) -> list[int]:
    """Interior boundaries of a simulated shape after keeping every `stride`-th row."""
    at = [0]
    for _, length in SHAPES[shape]:
        at.append(at[-1] + length)
    return [-(-b // stride) for b in at[1:-1]]


def annotations(spark: SparkSession) -> DataFrame:
    """dataset, annotator, pos: external change points on the native axis of the well log."""
    rows = [("welllog", who, ANNOTATION_STRIDE * p) for who, at in WELLLOG_ANNOTATIONS.items() for p in at]
    return spark.createDataFrame(rows, "dataset string, annotator string, pos int")


#: What a card says of each dataset: family, coordinate axis and role of the weights.
CARDS = {
    "welllog": ("gaussian", "observation-index", "none"),
    "cgh": ("gaussian", "probe-index", "precision"),
    "spx": ("gaussian", "trading-day-index", "none"),
    "methylation": ("beta", "genomic-position", "coverage"),
}


def read_any(spark: SparkSession, dataset: str, path: str, **options) -> DataFrame:
    readers = {"welllog": read_welllog, "cgh": read_probes, "spx": read_closes, "methylation": read_methylation}
    return readers[dataset](spark, path, **options)


def read_welllog(spark: SparkSession, path: str) -> DataFrame:
    """Numbers by line, or JSON if the file has none."""
    t = read_values(spark, path, "welllog")
    return t if t.limit(LEAST).count() == LEAST else read_json_values(spark, path, "welllog")


def load(spark: SparkSession, dataset: str, path: str | None = None, stride: int = 1, seed: int = 0, source_date: str | None = None, **options) -> tuple[DataFrame, dict]:
    """(sequence, card): a file of the dataset's format, or its simulated shape if there is no path or the file holds
    fewer than `LEAST` values (a table needs one row). The card has the origin, its date as given, the sizes, digests of
    data and weights, the boundaries of a simulated shape and the external annotations of a real one."""
    from .sequences import subsample

    if dataset not in CARDS:
        raise ValueError(f"unknown dataset {dataset!r}")
    if not isinstance(stride, int) or isinstance(stride, bool) or stride < 1:
        raise ValueError("stride must be a positive integer")
    if source_date is not None and not isinstance(source_date, str):
        raise TypeError("source_date must be a string")
    seq = read_any(spark, dataset, path, **options) if path else None
    least = 1 if path and dataset == "methylation" and is_table(spark, path) else LEAST
    real = seq is not None and seq.limit(least).count() == least
    seq = seq if real else simulate(spark, dataset, seed)
    seq = subsample(seq, stride) if stride > 1 else seq
    family, axis, role = CARDS[dataset]
    weighted = "w" in seq.columns and role != "none"
    size = seq.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq_id", *(["channel"] if "channel" in seq.columns else [])).alias("m")).first()
    notes = annotations(spark).where(F.col("dataset") == dataset)
    card = {
        "dataset": dataset, "source": "file" if real else "simulated", "uri": path if real else f"simulated:{dataset}:{seed}", "date": source_date, "stride": stride,
        "observations": size["n"], "sequences": size["m"], "family": family, "axis": axis if real else "observation-index", "weights": role if weighted else "none",
        "data_sha256": digest(seq, ["x", "y"]), "weights_sha256": digest(seq, ["w"]) if weighted else None,
        "boundaries": None if real else true_boundaries(dataset, stride), "annotators": sorted(r["annotator"] for r in notes.select("annotator").distinct().collect()) if real else [],
    }
    return seq, card


def read_closes(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Closing prices as log squared returns: one price per line, or lines of date,price in any order, of which those from
    `start` (included) to `end` (excluded) are kept."""
    from .sequences import log_squared_change

    head = spark.read.text(path).first()
    if not head or "," not in head[0]:
        if start or end:
            raise ValueError("a file without dates has no date window")
        return log_squared_change(read_values(spark, path, "spx").where("y > 0"))
    part = F.split("value", ",")
    t = spark.read.text(path).select(F.lit("spx").alias("seq_id"), F.trim(F.get(part, F.lit(0))).try_cast("date").alias("day"), _finite(F.trim(F.get(part, F.lit(1)))).alias("y"))
    t = t.where("day is not null and y > 0")
    t = t.where(F.col("day") >= F.lit(start).cast("date")) if start else t
    t = t.where(F.col("day") < F.lit(end).cast("date")) if end else t
    return log_squared_change(indexed(t, ["day", "y"]))


_ID, _SHA = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*"), re.compile(r"[0-9a-f]{64}")


def record(run_id: str, status: str, inputs: dict[str, str], outputs: list[str], metrics: dict[str, float]) -> dict:
    """A validated run record: ids, SHA-256 lineage of inputs and relative output paths only."""
    if not _ID.fullmatch(run_id):
        raise ValueError(f"bad run id {run_id!r}")
    if status not in ("ok", "failed", "partial"):
        raise ValueError(f"bad status {status!r}")
    if any(not _SHA.fullmatch(h) for h in inputs.values()):
        raise ValueError("inputs need SHA-256 digests")
    if any(p.startswith("/") or ".." in p.split("/") for p in outputs):
        raise ValueError("outputs need relative paths")
    return {"inputs": inputs, "metrics": metrics, "outputs": sorted(outputs), "run_id": run_id, "status": status}


def write_record(spark: SparkSession, rec: dict, path: str) -> None:
    """One JSON line with sorted keys; Spark's committer makes the write atomic."""
    spark.createDataFrame([(json.dumps(rec, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    rec = json.loads(spark.read.text(path).first()[0])
    return record(**rec)


def write_run(spark: SparkSession, path: str, dataset: str, source: str, figure: str, extra: dict | None = None) -> None:
    """Appends one row to a table of runs: what was drawn, from which dataset, when, and further values as JSON texts."""
    if figure.startswith("/") or ".." in figure.split("/"):
        raise ValueError("a run record needs a relative figure path")
    if source not in ("file", "simulated"):
        raise ValueError(f"unknown source {source!r}")
    more = {k: json.dumps(v, sort_keys=True, default=str) for k, v in (extra or {}).items()}
    row = spark.createDataFrame([(dataset, source, figure, more)], "dataset string, source string, figure string, extra map<string,string>")
    row.withColumn("ran_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
