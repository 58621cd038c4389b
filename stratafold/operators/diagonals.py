"""Blocks of two tiles of a sequence, gathered by length and sums.

The blocks of one length lie on a diagonal of the square of starts and ends. Where sums are whole numbers (counts) a
diagonal holds few distinct ones, so that blocks which share length and sums, and with them their score, become one row
with the list of their starts. Sums that are no whole numbers give as many rows as they differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Starts of an Arrow batch, about.
BATCH = 1 << 20


def steady(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether b[x + d] - a[x] is the same for all x: whole numbers in steps of one size."""
    both = np.concatenate([a, b])
    if not (np.isfinite(both).all() and (both == np.floor(both)).all() and np.abs(both).max() < 2**52):
        return False
    step = np.concatenate([np.diff(a), np.diff(b)])
    return not len(step) or bool((step == step[0]).all())


def small(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Two arrays whose sums u[x] + v[y] are b[y] - a[x] and a constant, in 0 .. width - 1, and the width; None unless
    they are whole numbers and the width has 16 bits."""
    for v in (a, b):
        if not (np.isfinite(v).all() and (v == np.floor(v)).all() and np.abs(v).max() < 2**52):
            return None
    width = (a.max() - a.min()) + (b.max() - b.min()) + 1
    return ((a.max() - a).astype(np.uint16), (b - b.min()).astype(np.uint16), int(width)) if width <= 2**16 else None


def gathered(left: list[np.ndarray], right: list[np.ndarray], same: bool, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, bounds, all starts) of groups of blocks: `left` and `right` hold positions, then sums, of the starts
    and ends; group g has the blocks of `all starts[bounds[g]:bounds[g + 1]]`, all alike to (start, end). All are numbers of
    rows in the tiles. `same`: both are one tile. Blocks that are longer than `most` may be left out."""
    n, m = len(left[0]), len(right[0])
    vary = [k for k in range(len(left)) if not steady(left[k], right[k])]
    few = small(left[vary[0]], right[vary[0]]) if len(vary) == 1 else None
    shift = np.arange(1 if same else 1 - n, m)
    if most:
        shift = shift[[(right[0][max(0, d) : min(m, n + d)] - left[0][max(0, -d) : min(n, m - d)]).min() <= most for d in shift]]
    at_once = max(1, min(2**16 // few[2] if few else 2**16, 2**16 // min(n, m)))  # diagonals
    out, held = [], 0
    for first in range(0, len(shift), at_once):
        d = shift[first : first + at_once]
        lo = np.maximum(0, -d)
        size = np.minimum(n, m - d) - lo
        which = np.repeat(np.arange(len(d), dtype=np.int32), size)
        x = np.arange(size.sum(), dtype=np.int32) + (lo - np.cumsum(size) + size).astype(np.int32)[which]
        y = x + d.astype(np.int32)[which]
        if few:
            v = few[0][x] + few[1][y] + (np.arange(len(d)) * few[2]).astype(np.uint16)[which]
            order = v.argsort(kind="stable")  # by digits, as the integers are short
            v = v[order]
            new = v[1:] != v[:-1]
        else:
            keys = [*(right[k][y] - left[k][x] for k in vary), which]
            order = np.lexsort(keys)
            new = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
        cut = np.concatenate([[0], np.flatnonzero(new) + 1])
        head = order[cut]
        out.append((x[head], y[head], np.diff(cut, append=len(x)), x[order]))
        held += len(x)
        if held >= BATCH or first + at_once >= len(shift):
            x, y, size, rows = (np.concatenate(c) for c in zip(*out, strict=True))
            yield x, y, np.concatenate([[0], np.cumsum(size)]), rows
            out, held = [], 0


def gather(keys: list[str], more: list[str], most: int | None):
    """For mapInArrow over pairs of tiles (seq_id, ti, tj, i, i_<key>, j, j_<key> as arrays, `more` as doubles): rows of
    seq_id, more, length, <key> (the block's sums) and starts."""
    import pyarrow as pa

    kinds = pa.schema([("seq_id", pa.string()), *[(c, pa.float64()) for c in more], ("length", pa.int32()), *[(k, pa.float64()) for k in keys], ("starts", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            col = {name: b.column(name) for name in b.schema.names}
            for r in range(b.num_rows):
                part = {c: col[c][r].values for c in ("i", "j", *[f"{e}_{k}" for e in "ij" for k in keys])}
                void = {c: v.is_null().to_numpy(zero_copy_only=False) for c, v in part.items() if v.null_count}
                i, j = part["i"].to_numpy(), part["j"].to_numpy()
                left, right = ([part[f"{e}_{k}"].to_numpy(zero_copy_only=False).astype(float) for k in keys] for e in "ij")
                marks = [[void.get(f"{e}_{k}", np.zeros(len(at), bool)).astype(float) for k in keys if f"i_{k}" in void or f"j_{k}" in void] for e, at in (("i", i), ("j", j))]
                same = col["ti"][r].as_py() == col["tj"][r].as_py()
                for x, y, bounds, rows in gathered([i.astype(float), *left, *marks[0]], [j.astype(float), *right, *marks[1]], same, most):
                    sums = []
                    for k, a, e in zip(keys, left, right, strict=True):
                        gone = np.zeros(len(x), bool)
                        for name, at in ((f"i_{k}", x), (f"j_{k}", y)):
                            gone |= void[name][at] if name in void else False
                        sums.append(pa.array(e[y] - a[x], pa.float64(), mask=gone))
                    each = [pa.array(np.full(len(x), np.nan if (v := col[c][r].as_py()) is None else v), pa.float64(), mask=np.full(len(x), v is None)) for c in more]
                    starts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(i[rows].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([col["seq_id"][r].as_py()] * len(x), pa.string()), *each, pa.array((j[y] - i[x]).astype(np.int32)), *sums, starts], schema=kinds)

    schema = ", ".join(["seq_id string", *[f"`{c}` double" for c in more], "length int", *[f"`{k}` double" for k in keys], "starts array<int>"])
    return run, schema
