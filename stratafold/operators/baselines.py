"""Frequentist change-point baselines on the L2 cost, one kernel per sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Cost:
    """Sum of squared deviations of any block from prefix sums."""

    def __init__(self, y: np.ndarray):
        self.n = len(y)
        self.s, self.q = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])

    def __call__(self, i, j):
        m = np.asarray(j) - np.asarray(i)
        return self.q[j] - self.q[i] - (self.s[j] - self.s[i]) ** 2 / np.maximum(m, 1)


def bic_penalty(sigma2: float, n: int, scale: float = 2.0) -> float:
    return scale * sigma2 * float(np.log(n))


def pelt(cost: Cost, penalty: float, min_size: int = 2) -> list[int]:
    """Optimal penalised partition. A candidate that is beaten at j by j itself cannot win once j may be the last change,
    that is from j + min_size on: only then it is dropped."""
    n = cost.n
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    live, until = np.array([0]), np.full(n + 1, n + 1)
    for j in range(min_size, n + 1):
        live = live[until[live] > j]
        ok = live[live <= j - min_size]
        v = best[ok] + cost(ok, j) + penalty
        k = int(v.argmin())
        best[j], last[j] = v[k], ok[k]
        beaten = ok[v - penalty > best[j]]
        until[beaten] = np.minimum(until[beaten], j + min_size)
        live = np.append(live, j)
    return _walk(last, n)


def _walk(last: np.ndarray, n: int) -> list[int]:
    out = [n]
    while out[-1] > 0:
        out.append(int(last[out[-1]]))
    return out[::-1]


def optimal(cost: Cost, changes: int, min_size: int = 2, candidates: list[int] | None = None) -> list[int]:
    """Best partition with exactly `changes` changes, at any or at candidate positions."""
    n = cost.n
    pos = np.array(sorted({0, n, *(candidates if candidates is not None else range(n + 1))}))
    m = len(pos)
    best, back = np.full((changes + 2, m), np.inf), np.zeros((changes + 2, m), int)
    best[0, 0] = 0.0
    for k in range(1, changes + 2):
        for j in range(1, m):
            ok = np.flatnonzero(pos[:j] <= pos[j] - min_size)
            if len(ok):
                v = best[k - 1, ok] + cost(pos[ok], pos[j])
                b = int(v.argmin())
                best[k, j], back[k, j] = v[b], ok[b]
    if not np.isfinite(best[changes + 1, m - 1]):
        raise ValueError("no partition with that many changes")
    out, j = [n], m - 1
    for k in range(changes + 1, 0, -1):
        j = back[k, j]
        out.append(int(pos[j]))
    return out[::-1]


def penalised(cost: Cost, penalty: float, candidates: list[int], min_size: int = 2) -> list[int]:
    """Best penalised partition at candidate positions."""
    pos = np.array(sorted({0, cost.n, *candidates}))
    best, last = np.full(len(pos), np.inf), np.zeros(len(pos), int)
    best[0] = -penalty
    for j in range(1, len(pos)):
        ok = np.flatnonzero(pos[:j] <= pos[j] - min_size)
        if len(ok):
            v = best[ok] + cost(pos[ok], pos[j]) + penalty
            k = int(v.argmin())
            best[j], last[j] = v[k], ok[k]
    out, j = [int(pos[-1])], len(pos) - 1
    while j:
        j = last[j]
        out.append(int(pos[j]))
    return out[::-1]


def _split(cost: Cost, i: int, j: int, min_size: int) -> tuple[float, int] | None:
    t = np.arange(i + min_size, j - min_size + 1)
    if not len(t):
        return None
    gain = cost(i, j) - cost(i, t) - cost(t, j)
    k = int(gain.argmax())
    return float(gain[k]), int(t[k])


def binary_segmentation(cost: Cost, changes: int | None = None, penalty: float | None = None, min_size: int = 2) -> list[int]:
    """Greedy splits: the largest gain first, until the number is reached or no gain exceeds the penalty."""
    if (changes is None) == (penalty is None):
        raise ValueError("exactly one of changes and penalty")
    cut = [0, cost.n]
    while changes is None or len(cut) - 2 < changes:
        found = [s for a, b in zip(cut[:-1], cut[1:], strict=True) if (s := _split(cost, a, b, min_size))]
        if not found or (penalty is not None and max(found)[0] <= penalty):
            break
        cut = sorted([*cut, max(found)[1]])
    return cut


def wild_binary_segmentation(cost: Cost, changes: int | None = None, penalty: float | None = None, windows: int = 100, seed: int = 0, min_size: int = 2) -> list[int]:
    """Best splits of random windows are the candidates of an exact search."""
    rng = np.random.default_rng(seed)
    ends = np.sort(rng.integers(0, cost.n + 1, (windows, 2)), axis=1)
    candidates = sorted({s[1] for a, b in [(0, cost.n), *ends.tolist()] if (s := _split(cost, a, b, min_size))})
    return optimal(cost, min(changes, len(candidates)), min_size, candidates) if changes is not None else penalised(cost, penalty, candidates, min_size)


def circular_binary_segmentation(cost: Cost, alpha: float = 0.01, permutations: int = 200, seed: int = 0, min_size: int = 2) -> list[int]:
    """Recursive splits at the arc (i, j] whose mean differs most from the rest of its block, while a permutation test of
    that difference stays below `alpha`."""
    y, rng = np.diff(cost.s), np.random.default_rng(seed)

    def arc(v: np.ndarray) -> tuple[float, int, int]:
        n, s = len(v), np.concatenate([[0.0], np.cumsum(v - v.mean())])
        i, j = np.triu_indices(n + 1, min_size)
        ok = (n - (j - i) >= min_size) & ((i == 0) | (i >= min_size)) & ((j == n) | (n - j >= min_size))
        i, j = i[ok], j[ok]
        if not len(i):
            return 0.0, 0, n
        z = (s[j] - s[i]) ** 2 / ((j - i) * (1 - (j - i) / n))
        k = int(z.argmax())
        return float(z[k]), int(i[k]), int(j[k])

    def cut(lo: int, hi: int) -> list[int]:
        v = y[lo:hi]
        z, i, j = arc(v)
        if z <= 0 or sum(arc(rng.permutation(v))[0] >= z for _ in range(permutations)) > alpha * permutations:
            return []
        ends = [lo, *[lo + p for p in (i, j) if 0 < p < hi - lo], hi]
        return ends[1:-1] + [c for a, b in zip(ends[:-1], ends[1:], strict=True) for c in cut(a, b)]

    return sorted({0, cost.n, *cut(0, cost.n)})


def multiscale(cost: Cost, threshold: float = 1.5, sigma: float | None = None) -> list[int]:
    """Fewest segments such that on every interval inside a segment the mean differs from the segment's level by less
    than (threshold + sqrt(2 log(e n / length))) sigma / sqrt(length); of these the one of least cost."""
    n, s = cost.n, cost.s
    if sigma is None:
        d = np.diff(np.diff(s))
        sigma = float(max(1.4826 * np.median(np.abs(d - np.median(d))) / np.sqrt(2), 1e-12)) if n > 2 else 1.0
    size = np.arange(1, n + 1)
    slack = (threshold + np.sqrt(2 * np.log(np.e * n / size))) * sigma / np.sqrt(size)
    count, best, last = np.full(n + 1, n + 2), np.full(n + 1, np.inf), np.zeros(n + 1, int)
    count[0], best[0] = 0, 0.0
    low, high = np.full(n + 1, -np.inf), np.full(n + 1, np.inf)  # of the block from i to the present end
    for j in range(1, n + 1):
        i = np.arange(j)
        mean, gap = (s[j] - s[i]) / (j - i), slack[j - i - 1]
        # intervals that end at j and start at i or later tighten every block that starts before them
        low[:j] = np.maximum(low[:j], np.maximum.accumulate((mean - gap)[::-1])[::-1])
        high[:j] = np.minimum(high[:j], np.minimum.accumulate((mean + gap)[::-1])[::-1])
        ok = np.flatnonzero(low[:j] <= high[:j])
        level = np.clip(mean[ok], low[ok], high[ok])
        total = best[ok] + cost(ok, j) + (j - ok) * (mean[ok] - level) ** 2
        k = np.lexsort((ok, total, count[ok]))[0]
        count[j], best[j], last[j] = count[ok[k]] + 1, total[k], ok[k]
    return _walk(last, n)


def sampled(cost: Cost, penalty: float, sigma2: float, steps: int = 4000, seed: int = 0, min_size: int = 1) -> list[int]:
    """Most probable change set visited by a Metropolis chain that adds, removes and moves changes; the log target is
    minus the penalised cost over 2 sigma2."""
    rng, n = np.random.default_rng(seed), cost.n
    value = lambda c: -(sum(cost(a, b) for a, b in zip(c[:-1], c[1:], strict=True)) + penalty * (len(c) - 2)) / (2 * sigma2)
    now = [0, n]
    v = value(now)
    best, top = now, v
    for _ in range(steps):
        inner, move = now[1:-1], int(rng.integers(3))
        if move == 0:
            new = sorted({*now, int(rng.integers(1, n))})
        elif inner:
            at = inner[int(rng.integers(len(inner)))]
            new = sorted(({*now} - {at}) | ({int(np.clip(at + rng.integers(-5, 6), 1, n - 1))} if move == 2 else set()))
        else:
            continue
        if new == now or min(np.diff(new)) < min_size or (move == 2 and len(new) != len(now)):
            continue
        # an added change has n - 1 places, a removed one as many as there are
        ratio = 0.0 if move == 2 else np.log((n - 1) / (len(new) - 2)) if move == 0 else np.log(len(inner) / (n - 1))
        u = value(new)
        if np.log(rng.random()) < u - v + ratio:
            now, v = new, u
            if v > top:
                best, top = now, v
    return best


METHODS = {
    "pelt": lambda c, **k: pelt(c, **k), "optimal": lambda c, **k: optimal(c, **k), "dynp": lambda c, **k: optimal(c, **k),
    "binseg": lambda c, **k: binary_segmentation(c, **k), "binary-segmentation": lambda c, **k: binary_segmentation(c, **k),
    "wbs": lambda c, **k: wild_binary_segmentation(c, **k), "cbs": lambda c, **k: circular_binary_segmentation(c, **k),
    "smuce": lambda c, **k: multiscale(c, **k), "mcmc": lambda c, **k: sampled(c, **k),
}


def detect(seq: DataFrame, method: str, scale: float | None = None, **parameters) -> DataFrame:
    """seq_id, boundaries, cost. `scale` sets a BIC penalty from each sequence's robust noise variance."""
    key = method.strip().lower().replace("_", "-")
    run_one = METHODS[key]

    def run(group, pdf):
        y = pdf.sort_values("idx")["y"].to_numpy(float)
        c, more = Cost(y), dict(parameters)
        if scale is not None:
            d = np.diff(y)
            sigma2 = max((1.4826 * np.median(np.abs(d - np.median(d)))) ** 2 / 2, 1e-6)
            more["penalty"] = bic_penalty(sigma2, len(y), scale)
            if key == "mcmc":
                more["sigma2"] = sigma2
        cut = run_one(c, **more)
        return pd.DataFrame([(group[0], cut, float(sum(c(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True))))], columns=["seq_id", "boundaries", "cost"])

    return seq.groupBy("seq_id").applyInPandas(run, "seq_id string, boundaries array<int>, cost double")


TASKS = ("univariate", "multivariate")


def request(seq: DataFrame, task: str, budget: int) -> DataFrame:
    """A validated comparator input: raw finite observations on a strictly increasing axis, one channel for univariate
    tasks. Fails on the first violation when it is read."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    if task not in TASKS or budget < 1:
        raise ValueError("unknown task or empty tuning budget")
    keys = ["seq_id", *(["channel"] if "channel" in seq.columns else [])]
    if task == "univariate" and len(keys) == 2:
        raise ValueError("a univariate task takes one channel")
    dx = F.col("x") - F.lag("x").over(Window.partitionBy(*keys).orderBy("idx"))
    ok = (F.coalesce(dx, F.lit(1.0)) > 0) & ~F.isnan("y") & (F.abs("y") < float("inf")) & F.col("y").isNotNull()
    return seq.withColumn("y", F.when(ok, F.col("y")).otherwise(F.raise_error("comparator input needs finite y and increasing x").cast("double")))
