"""Latent groups of sequences that share segmentation templates, by expectation-maximisation.

A sequence's block table is one vector in one row: the log evidence of block (i, j], by i, then j. All sequences of a fit
have the same number of rows. Templates are few and go to the tasks with the code. A round is one pass over the vectors:
each task weighs its sequences by the templates (E-step) and adds r times vector per group; the tasks' sums are added in
two steps, and one kernel per group finds its next template (M-step). Nothing is keyed by a block, so what a round
shuffles is a few vectors per task, however many sequences there are. All restarts, and all numbers of groups and folds
of `choose_groups`, advance in the same pass. The driver sees templates and one objective per run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import lse
from . import dp, families, prior, segment
from .lineage import cut

FLOOR = 0.01
#: Shares into which the tasks' sums of a group are added before the last step.
SHARES = 16
VECTOR = "scores array<double>"


def pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of each place of a vector."""
    return np.triu_indices(n + 1, 1)


def places(cuts, n: int) -> np.ndarray:
    """Places of a template's blocks in a vector."""
    i, j = np.array(cuts[:-1]), np.array(cuts[1:])
    return i * n - i * (i - 1) // 2 + (j - i - 1)


def rows_of(vec: DataFrame) -> int:
    """n of the vectors, which must be one length: m = n (n + 1) / 2."""
    r = vec.agg(F.min(F.size("scores")).alias("lo"), F.max(F.size("scores")).alias("hi")).first()
    if r["lo"] is None or r["lo"] != r["hi"]:
        raise ValueError("latent groups need sequences of one length")
    return int((2 * r["hi"] + 0.25) ** 0.5)


def vectors(seq: DataFrame, name: str, hyper: DataFrame) -> DataFrame:
    """seq_id, scores of every sequence: one kernel each, no block becomes a row."""
    names = families.FAMILIES[name][2] if name in families.FAMILIES else [c for c in hyper.columns if c != "seq_id"]
    rows = families.checked(seq, name).join(hyper.select("seq_id", *[F.col(x).alias(f"h_{x}") for x in names]), "seq_id")

    def run(key, pdf):
        s, _ = segment.family_tables(pdf, name, {x: float(pdf[f"h_{x}"].iloc[0]) for x in names})
        return {"seq_id": key, "scores": s[pairs(len(pdf))]}

    return segment.by_sequence(rows, [*families.ROW, *[f"h_{x}" for x in names]], run, f"seq_id string, {VECTOR}")


def packed(blocks: DataFrame) -> DataFrame:
    """The vectors of a block table (seq_id, i, j, log_a0) that has every block; tables of vectors stay as they are."""
    if "scores" in blocks.columns:
        return blocks.select("seq_id", "scores")
    rows = blocks.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "log_a0"))).alias("b"))
    return rows.select("seq_id", F.transform("b", lambda x: x["log_a0"]).alias("scores"))


def weighed(v: np.ndarray, at: list[np.ndarray], offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """E-step of vectors `v` (rows): responsibilities per template and the log likelihood. `offset` holds all that does
    not depend on the sequence."""
    score = np.stack([v[:, a].sum(axis=1) for a in at], axis=1) + offset
    z = lse(score, axis=1)
    return np.exp(score - z[:, None]), z


def nearest(v: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Soft assignment to the nearest seed vector; ties go to the first."""
    d = np.stack([((v - s) ** 2).sum(axis=1) for s in seeds], axis=1)
    r = np.full(d.shape, FLOOR / len(seeds))
    r[np.arange(len(v)), d.argmin(axis=1)] += 1 - FLOOR
    return r


PARTS = "run int, g int, share int, weight double, z double, total array<double>"


def pooled(vec: DataFrame, weigh, columns: list[str]) -> DataFrame:
    """run, g, weight, z, total: for each run and group the sums of r, of the log likelihood (on g = 0) and of r times
    vector. `weigh(vectors, other columns)` gives {run: (r, z)} for a batch; sequences outside a run have r and z zero."""
    import pyarrow as pa
    from pyspark import TaskContext

    schema = pa.schema([("run", pa.int32()), ("g", pa.int32()), ("share", pa.int32()), ("weight", pa.float64()), ("z", pa.float64()), ("total", pa.list_(pa.float64()))])

    def out(sums, share):
        return pa.RecordBatch.from_pylist([{"run": r, "g": g, "share": share, "weight": w, "z": z, "total": t} for (r, g), (w, z, t) in sums.items()], schema=schema)

    def add(sums, key, w, z, t):
        a = sums.get(key)
        sums[key] = (w, z, t) if a is None else (a[0] + w, a[1] + z, a[2] + t)

    def tasks(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for run, (r, z) in weigh(v, {c: b.column(c) for c in columns}).items():
                t = r.T @ v
                for g in range(r.shape[1]):
                    add(sums, (run, g), float(r[:, g].sum()), float(z.sum()) if g == 0 else 0.0, t[g])
        yield out(sums, TaskContext.get().partitionId() % SHARES)

    def shares(batches):
        sums: dict = {}
        for b in batches:
            t = b.column("total")
            for k, row in enumerate(b.select(["run", "g", "weight", "z"]).to_pylist()):
                add(sums, (row["run"], row["g"]), row["weight"], row["z"], np.array(t[k].values.to_numpy()))
        yield out(sums, 0)

    part = vec.select("scores", *columns).mapInArrow(tasks, PARTS)
    return part.repartition("run", "g", "share").mapInArrow(shares, PARTS).drop("share")


def solved(parts: DataFrame, one, schema: str) -> DataFrame:
    """`one(run, g, weight, z, total)`, a list of rows, for each group."""

    def run(key, pdf):
        rows = one(int(key[0]), int(key[1]), float(pdf["weight"].sum()), float(pdf["z"].sum()), np.sum(np.stack(pdf["total"]), axis=0))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return parts.groupBy("run", "g").applyInPandas(run, schema)


TEMPLATE = "run int, g int, weight double, z double, k int, cuts array<int>, log_g double, objective double"


def template_of(n: int, k_max: int, count, factor=None):
    """The M-step of one group: the number of segments and the template with the largest weighted evidence plus weight
    times log prior; ties go to fewer segments."""
    i, j = pairs(n)
    g = factor(i, j) if factor else None
    table = np.full((n + 1, n + 1), -np.inf)
    table[i, j] = 0.0 if g is None else g
    log_p, log_c = prior.count_prior(count, k_max), dp.log_normaliser(n, k_max, table if factor else None)

    def one(run, group, weight, z, total):
        s = np.full((n + 1, n + 1), -np.inf)
        s[i, j] = total if g is None else total + weight * g
        best, back = dp.best_paths(s, k_max)
        ok = np.isfinite(log_c)
        value = np.where(ok, best[1:, n] + weight * (log_p - np.where(ok, log_c, 0.0)), -np.inf)
        k = int(np.flatnonzero(value >= value.max() - 1e-12)[0]) + 1
        cuts = dp.backtrack(back, k, n)
        log_g = float(log_p[k - 1] - log_c[k - 1]) + (float(g[places(cuts, n)].sum()) if factor else 0.0)
        return [(run, group, weight, z, k, cuts, log_g, float(value[k - 1]))]

    return one


@dataclass(frozen=True)
class Run:
    """One restart: its number, how many groups, the seed of its first choice, the fold that it does not see."""

    number: int
    groups: int
    seed: int
    held: int | None = None


def seeds(vec: DataFrame, run: Run) -> np.ndarray:
    """The vectors of the run's first sequences in order of a hash: the top of each task, then of all."""
    rows = vec if run.held is None else vec.where(F.col("fold") != run.held)
    top = rows.orderBy(F.xxhash64("seq_id", F.lit(run.seed)), "seq_id").limit(run.groups)
    return np.array([r["scores"] for r in top.select("scores").collect()])


def templates(blocks: DataFrame, resp: DataFrame, k_max: int, count=None, factor=None) -> DataFrame:
    """M-step under given responsibilities (seq_id, g, r): g, pi, k, cuts, offset, weight, objective."""
    vec = packed(blocks)
    n = rows_of(vec)
    given = resp.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("g", "r"))).alias("given")).select("seq_id", F.transform("given", lambda x: x["r"]).alias("given"))

    def weigh(v, more):
        r = more["given"].flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        return {0: (r, np.zeros(len(v)))}

    t = solved(pooled(vec.join(given, "seq_id"), weigh, ["given"]), template_of(n, k_max, count, factor), TEMPLATE)
    total = resp.agg(F.sum("r").alias("all"))
    return t.join(F.broadcast(total)).select("g", (F.col("weight") / F.col("all")).alias("pi"), "k", "cuts", F.col("log_g").alias("offset"), "weight", "objective")


def _tables(rows, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Places and offsets of templates (cuts, offset, pi), in order of g."""
    rows = sorted(rows, key=lambda r: r["g"])
    return [places(r["cuts"], n) for r in rows], np.array([r["offset"] + np.log(max(r["pi"], 1e-300)) for r in rows])


def responsibilities(blocks: DataFrame, tmpl: DataFrame) -> DataFrame:
    """E-step: seq_id, g, r and z, the sequence's log likelihood, under templates (g = 0.., pi, cuts, offset)."""
    import pyarrow as pa

    vec = packed(blocks)
    at, offset = _tables(tmpl.select("g", "pi", "cuts", "offset").collect(), rows_of(vec))  # a row per group

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r, z = weighed(b.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), at, offset)
            ids = b.column("seq_id").take(pa.array(np.repeat(np.arange(len(r)), len(at))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(len(at), dtype=np.int32), len(r))), pa.array(r.reshape(-1)), pa.array(np.repeat(z, len(at)))], ["seq_id", "g", "r", "z"])

    return vec.mapInArrow(run, "seq_id string, g int, r double, z double")


def drops(trail: list[float], tol: float) -> bool:
    """Whether an objective falls by more than rounding explains."""
    return any(y < x - max(1e-10, tol * max(1.0, abs(x))) for x, y in zip(trail[:-1], trail[1:], strict=True))


def advance(vec: DataFrame, runs: list[Run], n: int, k_max: int, count, rounds: int, tol: float, factor=None) -> tuple[dict[int, list], dict[int, list[float]]]:
    """EM of all runs together on vectors (seq_id, scores, fold): per run its last templates and its objectives."""
    first = {r.number: seeds(vec, r) for r in runs}
    held = {r.number: -1 if r.held is None else r.held for r in runs}
    step = template_of(n, k_max, count, factor)

    def pass_over(state):
        def weigh(v, more):
            fold = more["fold"].to_numpy()
            out = {}
            for run, now in state.items():
                r, z = (nearest(v, now), np.zeros(len(v))) if isinstance(now, np.ndarray) else weighed(v, *now)
                seen = fold != held[run]
                out[run] = (r * seen[:, None], z * seen)
            return out

        found: dict[int, list] = {}
        for r in solved(pooled(vec, weigh, ["fold"]), step, TEMPLATE).collect():  # a row per run and group
            found.setdefault(r["run"], []).append(r.asDict() | {"offset": r["log_g"]})
        for rows in found.values():
            total = sum(r["weight"] for r in rows)
            for r in rows:
                r["pi"] = r["weight"] / total if total else 0.0
        return found

    now, trail, done = pass_over(first), {r.number: [] for r in runs}, {}
    for left in range(rounds, 0, -1):  # each pass weighs by the templates `now` and finds the ones after them
        nxt = pass_over({k: _tables(rows, n) for k, rows in now.items()})
        for k, rows in nxt.items():
            t = trail[k]
            t.append(sum(r["z"] for r in rows))
            if left == 1 or len(t) > 1 and abs(t[-1] - t[-2]) < tol * max(1.0, abs(t[-2])):
                done[k] = now[k]  # those that the last objective belongs to
        now = {k: rows for k, rows in nxt.items() if k not in done}
        if not now:
            break
    return done, trail


def fit(blocks: DataFrame, groups: int, k_max: int, restarts: int = 4, count=None, rounds: int = 25, tol: float = 1e-6, seed: int = 0, factor=None) -> dict[str, DataFrame]:
    """Best valid restart: templates (g in canonical order of (k, cuts)), members (seq_id, g, r, z), history (restart,
    round, objective, valid). A restart whose objective drops is invalid. `blocks` is a block table or `vectors`."""
    vec = cut(packed(blocks).withColumn("fold", F.lit(0)))
    spark, n = vec.sparkSession, rows_of(vec)
    state, trail = advance(vec, [Run(k, groups, seed + k) for k in range(restarts)], n, min(k_max, n), count, rounds, tol, factor)
    valid = {k: t for k, t in trail.items() if t and not drops(t, tol)}
    if not valid:
        raise ValueError("no restart kept its objective from dropping")
    best = max(sorted(valid), key=lambda k: valid[k][-1])
    named = sorted(state[best], key=lambda r: (r["k"], list(r["cuts"]), r["g"]))
    tmpl = spark.createDataFrame([(g, float(r["pi"]), r["k"], [int(c) for c in r["cuts"]], float(r["offset"])) for g, r in enumerate(named)], "g int, pi double, k int, cuts array<int>, offset double")
    history = spark.createDataFrame([(k, i, float(z), k in valid) for k, t in trail.items() for i, z in enumerate(t)], "restart int, round int, objective double, valid boolean")
    return {"templates": tmpl, "members": responsibilities(vec, tmpl), "history": history}


def predict(blocks: DataFrame, tmpl: DataFrame) -> DataFrame:
    """Responsibilities and log likelihood z of fresh sequences under fitted templates."""
    return responsibilities(blocks, tmpl)


def score(members: DataFrame) -> DataFrame:
    """Mean over sequences of the log of their largest responsibility."""
    top = members.groupBy("seq_id").agg(F.max("r").alias("r"))
    return top.agg(F.avg(F.log(F.greatest("r", F.lit(1e-300)))).alias("score"))


def group_marginals(blocks: DataFrame, members: DataFrame, tmpl: DataFrame) -> DataFrame:
    """Boundary probabilities (g, pos, p) of each group at its template's number of segments, on its weighted evidence."""
    vec = packed(blocks)
    n = rows_of(vec)
    segments = {r["g"]: r["k"] for r in tmpl.select("g", "k").collect()}  # a row per group
    given = members.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("g", "r"))).alias("given")).select("seq_id", F.transform("given", lambda x: x["r"]).alias("given"))

    def weigh(v, more):
        return {0: (more["given"].flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), np.zeros(len(v)))}

    def one(run, g, weight, z, total):
        s = np.full((n + 1, n + 1), -np.inf)
        s[pairs(n)] = total
        p = dp.marginals(dp.forward(s, segments[g]), dp.backward(s, segments[g]), segments[g])
        return [(g, q, float(p[q])) for q in range(1, n)]

    return solved(pooled(vec.join(given, "seq_id"), weigh, ["given"]), one, "g int, pos int, p double")


def choose_groups(blocks: DataFrame, candidates: list[int], k_max: int, folds: int = 3, count=None, restarts: int = 2, seed: int = 0, rounds: int = 8, tol: float = 1e-6) -> DataFrame:
    """Mean held-out log likelihood per number of groups; folds by a hash of the sequence. All fits advance together."""
    import pyarrow as pa

    vec = cut(packed(blocks).withColumn("fold", F.pmod(F.xxhash64("seq_id", F.lit(seed)), F.lit(folds)).cast("int")))
    n = rows_of(vec)
    held = {r["fold"]: r["count"] for r in vec.groupBy("fold").count().collect()}  # a row per fold
    runs, of = [], {}
    for g in candidates:
        for f in range(folds):
            if sum(held.values()) - held.get(f, 0) >= g:
                for k in range(restarts):
                    of[len(runs)] = (g, f)
                    runs.append(Run(len(runs), g, seed + k, f))
    state, trail = advance(vec, runs, n, min(k_max, n), count, rounds, tol)
    best: dict[tuple[int, int], int] = {}
    for k in sorted(trail):
        if trail[k] and not drops(trail[k], tol) and (of[k] not in best or trail[k][-1] > trail[best[of[k]]][-1]):
            best[of[k]] = k
    for key in set(of.values()) - set(best):
        raise ValueError(f"no restart kept its objective from dropping for {key[0]} groups without fold {key[1]}")
    fitted = {key: _tables(state[k], n) for key, k in best.items()}

    def held_out(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v, fold = b.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column("fold").to_numpy()
            for (g, f), now in fitted.items():
                z = weighed(v[fold == f], *now)[1] if (fold == f).any() else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), g, np.int32)), pa.array(z)], ["groups", "z"])

    out = vec.mapInArrow(held_out, "groups int, z double")
    return out.groupBy("groups").agg(F.avg("z").alias("held_out"), F.count(F.lit(1)).alias("sequences"))
