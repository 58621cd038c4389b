"""Exact fits of long sequences: the recursions of `dp` over tiles of columns.

Block scores are made from prefix sums inside a tile of `TILE` end positions and all starts before them, used for every
number of segments at once, and forgotten. What stays is a few tables of k_max times n. Two sweeps are made: forward
(sums, best scores and back pointers), and backward (sums; with the posterior known, the weights of blocks for the
posterior mean curve). A sweep in reverse reads the same prefix sums mirrored, so both see the same scores.

A tile adds the starts before it by one matrix product per chunk, with scores shifted by potentials (`dp.potentials`),
and its own starts number of segments by number of segments. Sums that underflow are done exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np

from ..functions.special import arrays, lse
from . import dp, prior

#: End positions of a tile, starts of a chunk.
TILE, CHUNK = 128, 1024
#: Log weight below which a block adds nothing to a curve.
FAINT = -60.0


@dataclass(frozen=True)
class Blocks:
    """Scores of blocks (i, j] from prefix sums. `factor(i, j)` gives log prior factors, -inf where a block is not allowed."""

    sums: dict[str, np.ndarray]
    evidence: Callable | None
    hyper: dict[str, float]
    factor: Callable | None = None

    @property
    def n(self) -> int:
        return len(next(iter(self.sums.values()))) - 1

    def score(self, i: np.ndarray, j: np.ndarray, mean: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(log score, mean) of blocks (i, j]; index arrays that broadcast. Pairs with i >= j get -inf."""
        ok = i < j
        g = self.factor(i, j) if self.factor else 0.0
        if self.evidence is None:
            return np.where(ok, g, -np.inf), None
        with np.errstate(all="ignore"):  # pairs that are no blocks have negative sums
            ev, mu = self.evidence({k: v[j] - v[i] for k, v in self.sums.items()}, self.hyper, arrays)
        return np.where(ok, ev + g, -np.inf), np.where(ok, mu, np.nan) if mean and mu is not None else None


def narrow_lse(a: np.ndarray) -> np.ndarray:
    """log sum exp of each row; terms below e^-50 of the largest, of which there are fewer than e^25, are left out."""
    top = a.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    r, c = np.nonzero(a > safe[:, None] - 50)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.bincount(r, np.exp(a[r, c] - safe[r]), len(a)))


def sweep(b: Blocks, k_max: int, reverse: bool = False, paths: bool = False, visit: Callable | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(L, M, back): L[k, p] the log sum over partitions of the first p rows (of the last p rows in reverse) into k
    blocks; with `paths` also the best scores and back pointers. `visit(columns, rows, scores, means, L)` sees every tile: scores[c, r] of the block
    between columns[c] and rows[r], in positions of the sweep."""
    n = b.n
    left = np.full((k_max + 1, n + 1), -np.inf)
    left[0, 0] = 0.0
    best = np.full(n + 1, -np.inf)  # the potentials
    best[0] = 0.0
    m, back = (np.full((k_max + 1, n + 1), -np.inf), np.full((k_max + 1, n + 1), -1, np.int32)) if paths else (None, None)
    if paths:
        m[0, 0] = 0.0
    for j0 in range(1, n + 1, TILE):
        cols = np.arange(j0, min(n + 1, j0 + TILE))
        j1, width = int(cols[-1]) + 1, len(cols)
        s = np.empty((width, j1))
        mu = np.empty((width, j1)) if visit else None
        for lo in range(0, j1, CHUNK):
            rows = np.arange(lo, min(j1, lo + CHUNK))
            i, j = (n - cols[:, None], n - rows[None, :]) if reverse else (rows[None, :], cols[:, None])
            part, mean = b.score(i, j, visit is not None)
            s[:, lo : lo + len(rows)] = part
            if visit:
                mu[:, lo : lo + len(rows)] = mean

        # potentials: starts before the tile together, starts inside it column by column
        top = np.full(width, -np.inf)
        for lo in range(0, j0, CHUNK):
            hi = min(j0, lo + CHUNK)
            top = np.maximum(top, (s[:, lo:hi] + best[lo:hi]).max(axis=1))
        for c in range(width):
            best[j0 + c] = max(top[c], (s[c, j0 : j0 + c] + best[j0 : j0 + c]).max(initial=-np.inf))
        pot = np.where(np.isfinite(best[:j1]), best[:j1], 0.0)
        reach = np.isfinite(best[:j1])

        prev = left[:k_max, :j0] - pot[:j0]
        scale = prev.max(axis=1)
        scale = np.where(np.isfinite(scale), scale, 0.0)
        weight = np.exp(prev - scale[:, None])
        total = np.zeros((k_max, width))
        with np.errstate(divide="ignore"):
            for lo in range(0, j0, CHUNK):
                hi = min(j0, lo + CHUNK)
                e = np.exp(np.where(reach[lo:hi], s[:, lo:hi] + pot[lo:hi] - pot[j0:j1, None], -np.inf))
                total += weight[:, lo:hi] @ e.T
            early = np.log(total) + scale[:, None]
            e = np.exp(np.where(reach[j0:], s[:, j0:] + pot[j0:] - pot[j0:, None], -np.inf))
            some = np.isfinite(s).any(axis=1)
            for k in range(k_max):
                own = left[k, j0:j1] - pot[j0:]
                t = own.max()
                value = early[k] if not np.isfinite(t) else np.logaddexp(early[k], np.log(e @ np.exp(own - t)) + t)
                ref = max(scale[k] if np.isfinite(prev[k]).any() else -np.inf, t)
                left[k + 1, j0:j1] = np.where(reach[j0:], value + pot[j0:], -np.inf)
                weak = np.flatnonzero(~(value - ref >= -600) & some) if np.isfinite(ref) else []
                for lo in range(0, len(weak), 16):
                    w = weak[lo : lo + 16]
                    left[k + 1, j0 + w] = narrow_lse(left[k, :j1] + s[w])

        for k in range(k_max if paths else 0):
            at, value = np.full(width, -1), np.full(width, -np.inf)
            for lo in range(0, j1, CHUNK):
                hi = min(j1, lo + CHUNK)
                t = s[:, lo:hi] + m[k, lo:hi]
                x = t.argmax(axis=1)
                v = t[np.arange(width), x]
                more = (v > value) | (at < 0)
                at, value = np.where(more, x + lo, at), np.where(more, v, value)
            m[k + 1, j0:j1], back[k + 1, j0:j1] = value, at
        if visit:
            visit(cols, np.arange(j1), s, mu, left)
    return left, m, back


def log_normaliser(b: Blocks, k_max: int) -> np.ndarray:
    """log C_k for k = 1..k_max, the sum of the prior factors over all partitions into k blocks."""
    if b.factor is None:
        return dp.log_normaliser(b.n, k_max, None)
    return sweep(Blocks(b.sums, None, {}, b.factor), k_max)[0][1:, -1]


class Curve:
    """Gathers the posterior mean curves of a backward sweep: the weight of block (i, j] is its score times the sums on
    both sides, over all numbers of segments."""

    def __init__(self, left: np.ndarray, log_weights: list[np.ndarray]):
        self.left, self.k_max, self.n = left, len(left) - 1, left.shape[1] - 1
        self.coef = []  # coef[p, q]: log of (weight of k) / (sum over partitions into k), k = p + q + 1
        for w in log_weights:
            ok = np.isfinite(w) & np.isfinite(left[1:, -1])
            z = np.full(self.k_max, -np.inf)
            z[ok] = w[ok] - left[1:, -1][ok]
            k = np.add.outer(np.arange(self.k_max), np.arange(self.k_max))
            self.coef.append(np.where(k < self.k_max, z[np.minimum(k, self.k_max - 1)], -np.inf))
        self.diff = np.zeros((len(log_weights), self.n + 1))

    def __call__(self, cols, rows, s, mean, right) -> None:
        i, j = self.n - cols, self.n - rows
        a, after = self.left[: self.k_max, i], right[: self.k_max, rows]
        for diff, coef in zip(self.diff, self.coef, strict=True):
            # b[p, r]: what follows position rows[r] if p blocks stand before and one between
            b = np.stack([lse(coef[p][:, None] + after, axis=0) for p in range(self.k_max)])
            for lo in range(0, len(rows), CHUNK):
                part = s[:, lo : lo + CHUNK]
                if (a.max(axis=1) + b[:, lo : lo + CHUNK].max(axis=1)).max() + part.max() <= FAINT:
                    continue
                top = np.full(part.shape, -np.inf)
                for p in range(self.k_max):
                    np.maximum(top, a[p][:, None] + b[p, lo : lo + CHUNK], out=top)
                c, r = np.nonzero(top + part > FAINT)
                if not len(c):
                    continue
                w = np.zeros(len(c))
                for p in range(self.k_max):
                    w += np.exp(a[p, c] + b[p, lo + r] + part[c, r])
                v = w * np.nan_to_num(mean[c, lo + r])
                np.add.at(diff, i[c], v)
                np.subtract.at(diff, j[lo + r], v)

    def values(self) -> list[np.ndarray]:
        return [np.cumsum(d)[: self.n] for d in self.diff]


def solve(row: dict, b: Blocks, k_max: int, count, curves: bool = True, k: int | None = None, log_c: np.ndarray | None = None) -> dict:
    """What `segment.solve` gives, for a sequence of any length; `row` is its empty result. `log_c` replaces the normaliser
    if the blocks are those of a lattice."""
    n = b.n
    k_max = min(k_max, n)
    left, best, back = sweep(b, k_max, paths=True)
    log_c = log_normaliser(b, k_max) if log_c is None else log_c[:k_max]
    log_p = prior.count_prior(count, k_max)
    try:
        post, z = dp.posterior_k(left, log_c, log_p)
    except ValueError as e:
        return row | {"error": str(e)}
    k_map = k or int(post.argmax()) + 1
    fixed = np.full(k_max, -np.inf)
    fixed[k_map - 1] = 0.0
    curve = Curve(left, [fixed, post]) if curves else None
    right = sweep(b, k_max, reverse=True, visit=curve)[0][:, ::-1]
    cut = dp.backtrack(back, k_map, n)
    mean = [float(b.score(np.array([i]), np.array([j]), True)[1][0]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    mixed = sum(np.exp(post[q - 1]) * dp.marginals(left, right, q) for q in range(2, k_max + 1) if np.isfinite(post[q - 1]))
    lines = curve.values() if curves else [None, None]
    return row | {
        "k_map": k_map, "log_evidence": z, "log_joint_map": float(best[k_map, n]), "log_c": log_c, "log_left_n": left[1:, n], "log_right_0": right[1:, 0], "log_post": post, "log_p": log_p,
        "boundaries": cut, "means": mean, "marginal": dp.marginals(left, right, k_map), "marginal_mixed": mixed + np.zeros(n + 1),
        "location": [x.tolist() for x in dp.locations(left, right, k_map)], "curve_fixed": lines[0], "curve_mixed": lines[1],
    }
