"""Change points by best splits of windows, as DataFrame operations: binary segmentation and its wild form.

Prefix sums are made in two levels (inside chunks of rows, then over chunks), so a long sequence is many tasks. Windows of
any size and overlap meet the positions inside them by an equi-join on (sequence, chunk) and keep the best split each,
combined map-side. Binary segmentation is rounds of that: only segments made in the round before are looked at again.
The exact search over few candidates at the end runs one small kernel a sequence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dp, segment, tiled
from .lineage import cut

#: Rows of a chunk.
ROWS = 4096


def prefix_sums(seq: DataFrame, rows: int = ROWS) -> DataFrame:
    """seq_id, chunk, pos, s, q: sums of y and of its square over the first pos rows, pos = 0..n."""
    t = seq.select("seq_id", F.col("idx").cast("int").alias("pos"), "y", (F.col("y") * F.col("y")).alias("y2")).withColumn("chunk", F.floor(F.col("pos") / rows).cast("int"))
    whole = t.groupBy("seq_id", "chunk").agg(F.sum("y").alias("cs"), F.sum("y2").alias("cq"))
    before = Window.partitionBy("seq_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    whole = whole.select("seq_id", "chunk", F.coalesce(F.sum("cs").over(before), F.lit(0.0)).alias("cs"), F.coalesce(F.sum("cq").over(before), F.lit(0.0)).alias("cq"))
    inside = Window.partitionBy("seq_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("s", F.sum("y").over(inside)).withColumn("q", F.sum("y2").over(inside)).join(whole, ["seq_id", "chunk"])
    t = t.select("seq_id", "chunk", "pos", (F.col("s") + F.col("cs")).alias("s"), (F.col("q") + F.col("cq")).alias("q"))
    zero = t.where("pos = 1").select("seq_id", F.lit(0).alias("chunk"), F.lit(0).alias("pos"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return t.unionByName(zero)


def _cost(s, q, n):
    return q - s * s / n


def best_splits(prefix: DataFrame, windows: DataFrame, min_size: int = 2, rows: int = ROWS) -> DataFrame:
    """For each window (seq_id, lo, hi) the split with the largest gain in squared deviation, parts of at least `min_size`
    rows: seq_id, lo, hi, pos, gain; ties go to the larger position. Windows without a split are absent."""
    w = windows.select("seq_id", "lo", "hi").where(F.col("hi") - F.col("lo") >= 2 * min_size).distinct()
    for end in ("lo", "hi"):
        at = prefix.select("seq_id", F.col("pos").alias(end), F.col("s").alias(f"s_{end}"), F.col("q").alias(f"q_{end}"))
        w = w.join(at, ["seq_id", end])
    chunks = F.sequence(F.floor((F.col("lo") + min_size) / rows).cast("int"), F.floor((F.col("hi") - min_size) / rows).cast("int"))
    t = w.withColumn("chunk", F.explode(chunks)).join(prefix, ["seq_id", "chunk"]).where((F.col("pos") >= F.col("lo") + min_size) & (F.col("pos") <= F.col("hi") - min_size))
    c = F.col
    whole = _cost(c("s_hi") - c("s_lo"), c("q_hi") - c("q_lo"), c("hi") - c("lo"))
    gain = whole - _cost(c("s") - c("s_lo"), c("q") - c("q_lo"), c("pos") - c("lo")) - _cost(c("s_hi") - c("s"), c("q_hi") - c("q"), c("hi") - c("pos"))
    best = t.select("seq_id", "lo", "hi", F.struct(gain.alias("gain"), "pos").alias("b")).groupBy("seq_id", "lo", "hi").agg(F.max("b").alias("b"))
    return best.select("seq_id", "lo", "hi", "b.pos", "b.gain")


def _ends(prefix: DataFrame) -> DataFrame:
    return prefix.groupBy("seq_id").agg(F.lit(0).alias("lo"), F.max("pos").alias("hi"))


def _children(split: DataFrame) -> DataFrame:
    c = F.explode(F.array(F.struct(F.col("lo").alias("lo"), F.col("pos").alias("hi")), F.struct(F.col("pos").alias("lo"), F.col("hi").alias("hi")))).alias("c")
    return split.select("seq_id", c).select("seq_id", "c.lo", "c.hi")


def binary_segmentation(seq: DataFrame, changes: int | None = None, penalty: float | None = None, min_size: int = 2, rows: int = ROWS) -> DataFrame:
    """seq_id, boundaries, cost. With `changes` the largest gain of a sequence is split first, a split a round; with
    `penalty` every segment whose gain exceeds it is split, all of a round at once, which comes to the same segments."""
    if (changes is None) == (penalty is None):
        raise ValueError("exactly one of changes and penalty")
    prefix = cut(prefix_sums(seq, rows))
    found = _ends(prefix).select("seq_id", F.array("lo", "hi").alias("cuts"))
    open_ = cut(best_splits(prefix, _ends(prefix), min_size, rows))
    done, left = [], changes
    while left is None or left > 0:
        if penalty is not None:
            chosen, rest = open_.where(F.col("gain") > penalty), None
        else:
            top = open_.groupBy("seq_id").agg(F.max(F.struct("gain", "pos")).alias("m")).select("seq_id", "m.pos")
            chosen, rest = open_.join(top, ["seq_id", "pos"], "left_semi"), open_.join(top, ["seq_id", "pos"], "left_anti")
        chosen = cut(chosen)
        if not chosen.limit(1).count():
            break
        done.append(chosen.select("seq_id", "pos"))
        nxt = best_splits(prefix, _children(chosen), min_size, rows)
        open_ = cut(nxt if rest is None else nxt.unionByName(rest))
        left = None if left is None else left - 1
    for d in done:
        found = found.unionByName(d.select("seq_id", F.array("pos").alias("cuts")))
    return costed(found.groupBy("seq_id").agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("boundaries")), prefix)


def costed(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """`found` (seq_id, boundaries) with the squared deviation of its segments."""
    at = found.select("seq_id", F.posexplode("boundaries").alias("k", "pos")).join(prefix.select("seq_id", "pos", "s", "q"), ["seq_id", "pos"])
    by = Window.partitionBy("seq_id").orderBy("k")
    d = at.withColumn("c", _cost(F.col("s") - F.lag("s").over(by), F.col("q") - F.lag("q").over(by), F.col("pos") - F.lag("pos").over(by)))
    return found.join(d.groupBy("seq_id").agg(F.sum("c").alias("cost")), "seq_id")


def wild_windows(seq: DataFrame, windows: int, seed: int = 0) -> DataFrame:
    """seq_id, lo, hi: the whole of each sequence and `windows` stretches of it, whose ends follow from a digest of the
    sequence's name, the stretch's number and the seed."""
    n = seq.groupBy("seq_id").agg(F.max("idx").cast("int").alias("n"))
    t = n.withColumn("h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.md5(F.concat_ws(":", F.col("seq_id"), k.cast("string"), F.lit(str(seed))).cast("binary")))))
    end = lambda k: F.floor(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") / F.lit(2.0**32) * (F.col("n") + 1)).cast("int")
    return t.select("seq_id", F.least(end(0), end(1)).alias("lo"), F.greatest(end(0), end(1)).alias("hi")).unionByName(n.select("seq_id", F.lit(0).alias("lo"), F.col("n").alias("hi")))


def wild_binary_segmentation(seq: DataFrame, changes: int | None = None, penalty: float | None = None, windows: int = 100, seed: int = 0, min_size: int = 2, rows: int = ROWS) -> DataFrame:
    """seq_id, boundaries, cost: the best splits of wild windows are the candidates of an exact search."""
    if (changes is None) == (penalty is None):
        raise ValueError("exactly one of changes and penalty")
    prefix = cut(prefix_sums(seq, rows))
    at = best_splits(prefix, wild_windows(seq, windows, seed), min_size, rows).select("seq_id", "pos").unionByName(_ends(prefix).select("seq_id", F.explode(F.array("lo", "hi")).alias("pos"))).distinct()
    few = at.join(prefix.select("seq_id", "pos", "s", "q"), ["seq_id", "pos"]).withColumn("idx", F.col("pos"))

    def run(key, pdf):
        pos, s, q = (pdf[c].to_numpy() for c in ("pos", "s", "q"))
        i, j = np.triu_indices(len(pos), 1)
        t = np.full((len(pos), len(pos)), -np.inf)
        t[i, j] = np.where(pos[j] - pos[i] >= min_size, -_cost(s[j] - s[i], q[j] - q[i], pos[j] - pos[i]) - (penalty or 0.0), -np.inf)
        most = len(pos) - 1 if penalty is not None else min(changes, len(pos) - 2) + 1
        best, back = dp.best_paths(t, most)
        fits = np.flatnonzero(np.isfinite(best[1:, -1])) + 1  # short parts can rule out the largest numbers
        k = int(best[1:, -1].argmax()) + 1 if penalty is not None else int(fits[-1])
        return {"seq_id": key, "boundaries": pos[dp.backtrack(back, k, len(pos) - 1)].astype(np.int32)}

    return costed(segment.by_sequence(few, ["pos", "s", "q"], run, "seq_id string, boundaries array<int>"), prefix)


def optimal_partition(seq: DataFrame, changes: int, min_size: int = 2) -> DataFrame:
    """seq_id, boundaries, cost: the partition of least squared deviation with exactly `changes` changes, by the same tiles
    as a long fit, so memory is k n and one tile."""

    def evidence(b, h, ns):
        return -_cost(b["s"], b["q"], ns.greatest(b["n"], 1.0)), None

    def run(key, pdf):
        y = pdf["y"].to_numpy(float)
        sums = {k: np.concatenate([[0.0], np.cumsum(v)]) for k, v in {"s": y, "q": y * y, "n": np.ones(len(y))}.items()}
        b = tiled.Blocks(sums, evidence, {}, segment.length_factor(min_size))
        if (changes + 1) * min_size > len(y):
            raise ValueError(f"no partition of {len(y)} rows with {changes} changes")
        _, best, back = tiled.sweep(b, changes + 1, paths=True)
        return {"seq_id": key, "boundaries": dp.backtrack(back, changes + 1, len(y)), "cost": -float(best[changes + 1, -1])}

    return segment.by_sequence(seq, ["y"], run, "seq_id string, boundaries array<int>, cost double")
