"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

Tree. k-means with `BRANCH` children per node is fitted level by level on a bounded sample of at most `SAMPLE` unit
vectors, until a node holds fewer than `LEAF` of them. Every vector of the table is then sent down the tree to its leaf.
Search. A query descends with a priority queue of nodes ordered by their distance to it (best bin first) and visits the
first leaves found. The number of visits is calibrated: on `PROBES` of the queries, compared with brute force over all
vectors, visits are widened by half until the recall reaches `RECALL`; with as many visits as leaves it is exact.
Ranking. Candidates are ranked by the cosine in double precision on the original vectors.

Scale and skew. Candidates meet queries by (leaf, part, share): a leaf with more than `PART` vectors is split into parts
of about that size, and one that more than `ASKED` queries visit into shares of them, so a crowded or popular leaf is
many tasks, each with bounded sides; each keeps the best `k` per query, so few rows go on. The tree, the probes and the
calibration's brute force are bounded by parameters; brute force is a scan with `PROBES` broadcast vectors.

Defined cases. Vectors that are null, empty, zero or hold null or non-finite components, have a null id or another length
than the most common one take no part. Equal scores go to the smaller id. Repeated rows of an id are candidates of their
own; repeated queries each get theirs. Fewer candidates than k: all of them. Empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BRANCH, LEAF, SAMPLE = 16, 256, 40_000
PROBES, RECALL, PART, ASKED = 128, 0.95, 2048, 1024
SEED = 5


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one. Each is first brought near 1 by a power of two, which is exact, so that squares of very large
    or very small components neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Nodes in arrays: centre, children (empty for a leaf) and the leaf's number."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF):
        rng = np.random.default_rng(SEED)
        self.centres, self.children, self.leaf_no, self.leaves = [sample.mean(axis=0) if len(sample) else np.zeros(1)], [[]], [-1], 0
        queue = [(0, np.arange(len(sample)))]
        while queue:
            node, rows = queue.pop()
            groups = self.split(sample[rows], branch, rng) if len(rows) > leaf else []
            if len(groups) < 2:
                self.leaf_no[node] = self.leaves
                self.leaves += 1
                continue
            for centre, part in groups:
                self.centres.append(centre)
                self.children.append([])
                self.leaf_no.append(-1)
                self.children[node].append(len(self.centres) - 1)
                queue.append((len(self.centres) - 1, rows[part]))
        self.centres = np.array(self.centres)

    @staticmethod
    def split(x: np.ndarray, branch: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        c = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(8):
            at = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            c = np.array([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(len(c))])
        at = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        return [(c[k], np.flatnonzero(at == k)) for k in range(len(c)) if (at == k).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_no[node]
                continue
            c = self.centres[kids]
            at = ((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            stack += [(kids[k], rows[at == k]) for k in range(len(kids)) if (at == k).any()]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves in best-bin-first order."""
        out, queue = [], [(0.0, 0)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf_no[node])
                continue
            d = ((self.centres[kids] - q) ** 2).sum(axis=1)
            for k, x in zip(kids, d.tolist(), strict=True):
                heapq.heappush(queue, (x, k))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v ARRAY<DOUBLE>: the rows that take part."""
    v = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (size["d"] if size else 0))


def matrix(column) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: larger score first, then smaller id."""
    keep = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


HITS = "row long, query_id long, vec_id long, score double"


def _scan(vectors: DataFrame, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Exact best k of each broadcast query, by a scan of all vectors."""
    import pyarrow as pa

    shared = vectors.sparkSession.sparkContext.broadcast((rows, ids, unit(q)))

    def run(batches):
        rows, qid, qs = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            vid = b.column("vec_id").to_numpy()
            s = qs @ unit(matrix(b.column("v"))).T
            for r in range(len(qid)):
                other = np.flatnonzero(vid != qid[r])
                top = other[best_of(s[r, other], vid[other], k)]
                cols = [pa.array(np.full(len(top), rows[r])), pa.array(np.full(len(top), qid[r])), pa.array(vid[top]), pa.array(s[r, top])]
                yield pa.RecordBatch.from_arrays(cols, ["row", "query_id", "vec_id", "score"])

    return _ranked(vectors.mapInArrow(run, HITS), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")


def _search(indexed: DataFrame, parts: DataFrame, queries: DataFrame, tree: Tree, visits: int, k: int) -> DataFrame:
    import pandas as pd
    import pyarrow as pa

    shared = indexed.sparkSession.sparkContext.broadcast(tree)

    def route(batches):
        t = shared.value
        for b in batches:
            if b.num_rows:
                leaves = [t.visit(q, visits) for q in unit(matrix(b.column("v")))]
                at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in leaves]))
                yield pa.RecordBatch.from_arrays([pa.array([y for x in leaves for y in x], pa.int32()), b.column("row").take(at)], ["leaf", "row"])

    routed = materialise(queries.mapInArrow(route, "leaf int, row long"))
    shares = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("shares"))  # one row per leaf
    plan = F.broadcast(materialise(parts.join(shares, "leaf")))
    asked = routed.join(plan, "leaf").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(queries, "row").select("leaf", "part", "share", "row", "vec_id", "v")
    indexed = indexed.join(plan, "leaf").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("leaf", "part", "share", "vec_id", "v")

    def match(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        vid, qid, rows = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), right["row"].to_numpy()
        v, q = unit(np.stack(left["v"])), unit(np.stack(right["v"]))
        out = []
        for r in range(len(qid)):
            s = v @ q[r]
            other = np.flatnonzero(vid != qid[r])
            top = other[best_of(s[other], vid[other], k)]
            out.append((np.full(len(top), rows[r]), np.full(len(top), qid[r]), vid[top], s[top]))
        return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("row", "query_id", "vec_id", "score"))})

    key = ["leaf", "part", "share"]
    return _ranked(indexed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(match, HITS), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
    """Best k of `vectors` for each row of `queries` (both vec_id long, embedding): query_id, rank, vec_id, score. The
    result's attributes `visits`, `leaves` and `recall` say what the calibration came to."""
    import pyarrow as pa

    v = materialise(usable(vectors))
    q = materialise(usable(queries).withColumn("row", F.monotonically_increasing_id()))
    spark = v.sparkSession
    n = v.count()
    some = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * SAMPLE / max(n, 1)) + 1))
    drawn = some.orderBy("vec_id").limit(2 * SAMPLE).select("v").toArrow()  # a sample of about SAMPLE rows, by hash
    tree = Tree(unit(matrix(drawn.column("v").combine_chunks())) if drawn.num_rows else np.zeros((0, 1)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(shared.value.assign(unit(matrix(b.column("v")))))], ["vec_id", "v", "leaf"])

    placed = materialise(v.mapInArrow(place, "vec_id long, v array<double>, leaf int"))
    parts = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # one row per leaf
    indexed = placed.join(F.broadcast(parts), "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    probes = q.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(PROBES)
    p = probes.toArrow()
    visits, reached = min(8, tree.leaves), 1.0
    if p.num_rows:
        rows, ids, m = p.column("row").to_numpy(), p.column("vec_id").to_numpy(), matrix(p.column("v").combine_chunks())
        want = {(r["row"], r["vec_id"]) for r in _scan(v, rows, ids, m, k).collect()}
        few = q.where(F.col("row").isin([int(x) for x in rows]))
        while visits < tree.leaves:
            got = {(r["row"], r["vec_id"]) for r in _search(indexed, parts, few, tree, visits, k).collect()}
            reached = len(got & want) / max(1, len(want))
            if reached >= recall:
                break
            visits, reached = min(visits + max(1, visits // 2), tree.leaves), 1.0
    out = _search(indexed, parts, q, tree, visits, k).drop("row")
    out.visits, out.leaves, out.recall = visits, tree.leaves, reached
    return out


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: vectors whose id is divisible by 50 against all others."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return nearest(v, v.where("vec_id % 50 = 0"))
