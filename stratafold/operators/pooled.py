"""Sequences that share boundaries: channels, replicates and known groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_avg, exact_sum
from . import families, predict, segment


def member_blocks(seq: DataFrame, name: str, member: str, hyper: DataFrame | None = None) -> DataFrame:
    """Block tables of each (seq_id, member) with hyperparameters of its own: adds the column `member`."""
    one = seq.withColumn("set_id", F.col("seq_id")).withColumn("seq_id", F.concat_ws("|", "seq_id", F.col(member).cast("string")))
    h = hyper if hyper is not None else families.hyper(one, name)
    keys = one.select("seq_id", "set_id", F.col(member).alias("member")).distinct()
    return families.blocks(one, name, h).join(keys, "seq_id").select(F.col("set_id").alias("seq_id"), "member", "i", "j", "log_a0", "a1")


def pool(blocks: DataFrame) -> DataFrame:
    """Sums evidence over members where all of them have support; a1 is the members' mean of block means. Both sums are
    exact, so the same members give the same bits in any order and partitioning."""
    size = blocks.groupBy("seq_id").agg(F.count_distinct("member").alias("size"))
    p = blocks.groupBy("seq_id", "i", "j").agg(exact_sum("log_a0").alias("log_a0"), exact_avg("a1").alias("a1"), F.count(F.lit(1)).alias("got"))
    return p.join(size, "seq_id").where("got = size").select("seq_id", "i", "j", "log_a0", "a1")


def shared(seq: DataFrame, name: str, member: str, k_max: int, count="uniform", hyper: DataFrame | None = None) -> tuple[segment.Fit, DataFrame]:
    """(pooled fit, per-member segment means). Channels use a uniform count prior by default, replicates geometric."""
    b = member_blocks(seq, name, member, hyper)
    fit = segment.fit_blocks(pool(b), k_max, count, curves=False)
    return fit, fit.segment.drop("mean").join(b, ["seq_id", "i", "j"]).select("seq_id", "member", "q", "i", "j", F.col("a1").alias("mean"))


def predict_members(seq: DataFrame, means: DataFrame, queries: DataFrame, policy: str = "nearest") -> DataFrame:
    """Step value of every member at each query (seq_id, x): the segment's mean of the member, found on the shared axis."""
    at = predict.locate(seq.select("seq_id", "idx", "x").distinct(), queries, policy)
    return at.join(means, "seq_id").where((F.col("idx") > F.col("i")) & (F.col("idx") <= F.col("j"))).drop("i", "j")


def score_shared(fit: segment.Fit, members: int = 1) -> DataFrame:
    """Log evidence per row: by n for channels, by n times the members for replicates."""
    return fit.summary.select("seq_id", (F.col("log_evidence") / (F.col("n") * members)).alias("score"))


def score_independent(fit: segment.Fit) -> DataFrame:
    """Mean over the members of their log evidence per row."""
    one = fit.summary.select(F.substring_index("seq_id", "|", 1).alias("seq_id"), (F.col("log_evidence") / F.col("n")).alias("v"))
    return one.groupBy("seq_id").agg(F.avg("v").alias("score"))


def independent(seq: DataFrame, name: str, member: str, k_max: int, hyper: DataFrame | None = None) -> tuple[segment.Fit, DataFrame]:
    """(fits per member under seq_id|member, evidence summed per sequence)."""
    one = seq.withColumn("seq_id", F.concat_ws("|", "seq_id", F.col(member).cast("string")))
    fit = segment.segment(one, name, k_max, hyper, curves=False)
    total = fit.summary.groupBy(F.substring_index("seq_id", "|", 1).alias("seq_id")).agg(exact_sum("log_evidence").alias("log_evidence"), F.count(F.lit(1)).alias("members"))
    return fit, total


def evidence_levels(summary: DataFrame, levels: list[str]) -> DataFrame:
    """Log evidence at every level of `levels` (columns of `summary`, coarse to fine) and of all, in one pass: the levels,
    level (0 for the finest; the bits say which columns are summed over), log_evidence, per_row, sequences."""
    t = summary.rollup(*levels).agg(F.grouping_id().alias("level"), exact_sum("log_evidence").alias("log_evidence"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sequences"))
    return t.select(*levels, "level", "log_evidence", (F.col("log_evidence") / F.col("n")).alias("per_row"), "sequences")


def exemplars(seq: DataFrame, label: str = "label") -> DataFrame:
    """One pooled sequence per label: weighted mean of y, weights summed, at each idx."""
    return seq.groupBy(F.col(label).cast("string").alias("seq_id"), "idx").agg(
        F.min("x").alias("x"), (exact_sum(F.col("w") * F.col("y")) / exact_sum("w")).alias("y"), exact_sum("w").alias("w"), *[F.first(c).alias(c) for c in ("a", "n_trials", "r", "phi")]
    )


def classify(train: DataFrame, fresh: DataFrame, name: str, k_max: int, hyper: DataFrame | None = None, prior: str = "empirical") -> DataFrame:
    """Group probabilities of fresh sequences (seq_id, x, y): predictive log density under each label's exemplar plus
    the log prior, normalised. Exemplars are one short table per label; fresh rows meet each label once."""
    ex = exemplars(train)
    h = hyper if hyper is not None else families.hyper(ex, name)
    fit = segment.segment(ex, name, k_max, h, curves=False)
    labels = train.groupBy(F.col("label").cast("string").alias("seq_id")).agg(F.count_distinct("seq_id").cast("double").alias("weight"))
    names = F.array(*[F.lit(r["seq_id"]) for r in labels.select("seq_id").collect()])  # one row per group
    asked = fresh.select(F.explode(names).alias("seq_id"), F.col("seq_id").alias("unit_id"), "x", "y", "w")
    scores = predict.unit_scores(predict.score_points(ex, name, fit.segment, h, asked))
    out = predict.unit_responsibility(scores, labels if prior == "empirical" else None)
    return out.select("unit_id", F.col("seq_id").alias("label"), "log_score", "prob")


def hard_label(probs: DataFrame) -> DataFrame:
    """Most probable label per sequence; ties go to the smaller label."""
    return probs.groupBy("unit_id").agg(F.min_by("label", F.struct((-F.col("prob")).alias("p"), "label")).alias("label"))
