"""Connected components of an undirected edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rounds after which the contraction must have ended; each roughly halves every path, so this is out of reach.
MOST_ROUNDS = 64
#: Rows of a key from which on it is a hub, and how many hubs are broadcast at most.
HUB, MOST_HUBS = 1024, 100_000


def attach(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """`rows` joined with `found` (one row per key; n, how many rows have it, is dropped). Keys with more than `HUB` rows
    meet theirs by a broadcast, so their rows stay where they are; if there are more than `MOST_HUBS` of them, all rows
    are shuffled."""
    hubs = found.where(F.col("n") > HUB).drop("n")
    few = hubs.limit(MOST_HUBS + 1).collect()
    if not 0 < len(few) <= MOST_HUBS:
        return rows.join(found.drop("n"), key)
    hubs = F.broadcast(rows.sparkSession.createDataFrame(few, hubs.schema))
    others = rows.join(hubs.select(key), key, "left_anti").join(found.where(F.col("n") <= HUB).drop("n"), key)
    return rows.join(hubs, key).unionByName(others)


def _mins(pairs: DataFrame) -> DataFrame:
    """For each u the smallest node of u and its neighbours, and its number of pairs; combined map-side."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """`edges` (u long, v long; any order, repeats and loops allowed) to (node, root): root is the smallest node of the
    component. Nodes without edges to others are absent. Every round is written to the shared folder, and the one before
    is freed."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        # large-star: hang each larger neighbour on the smallest node around
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = attach(both, "u", _mins(both)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: hang each smaller neighbour, and the node itself, on the smallest one; here no node has many
        m = _mins(large).drop("n")
        low = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialise(low.unionByName(m.select("u", F.col("m").alias("v")).where("u <> v")).distinct())
        discard(e)
        e = new
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
