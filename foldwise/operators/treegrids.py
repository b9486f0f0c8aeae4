"""Forests over few columns by tables: a tree's leaves are boxes on the grid of its own cuts.

A row finds its cell of a tree by one look-up a column, so a tree costs a row some look-ups, however deep it is. The same tables, of each
set of columns with the others averaged by the branches' covers, hold what Shapley values need. A tree whose grid has more than CELLS
cells is walked instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations, product

import numpy as np
import pandas as pd

from foldwise.functions.memory import keep_memory

#: Cells of a tabulated tree and columns of explained ones at most; rows of a step; rows that a task gathers for one set of tables.
CELLS, COLUMNS, BLOCK, CHUNK = 1 << 22, 6, 1 << 14, 1 << 19


class Boxes:
    """Leaves of a tree: ``low <= bin < high`` in each column that it uses, and by column the share of the branches' cover."""

    def __init__(self, t: dict) -> None:
        f, n = np.asarray(t["feature"]), len(t["feature"])
        self.columns = np.unique(f[f >= 0]).tolist()
        self.cuts = [np.unique(t["threshold"][f == c]) for c in self.columns]
        place, cut = np.zeros(n, int), np.zeros(n, int)
        for j, c in enumerate(self.columns):
            place[f == c], cut[f == c] = j, np.searchsorted(self.cuts[j], t["threshold"][f == c])
        p = len(self.columns)
        low, high, cold = np.zeros((n, p), int), np.tile([len(c) + 1 for c in self.cuts], (n, 1)).astype(int), np.ones((n, p))
        live, leaves = np.array([0]), []
        while len(live):
            leaves.append(live[f[live] < 0])
            live = live[f[live] >= 0]
            j, below = place[live], []
            for child, end in ((t["left"][live], high), (t["right"][live], low)):
                low[child], high[child], cold[child] = low[live], high[live], cold[live]
                end[child, j] = cut[live] + 1
                cold[child, j] *= np.where(t["cover"][live] > 0, t["cover"][child] / np.where(t["cover"][live] > 0, t["cover"][live], 1), 0.5)
                below.append(child)
            live = np.concatenate(below)
        at = np.concatenate(leaves)
        self.low, self.high, self.cold = low[at], np.maximum(high[at], low[at]), cold[at]
        self.value = t["value"][at] * t["weight"]

    @property
    def cells(self) -> int:
        return math.prod(len(c) + 1 for c in self.cuts)

    def table(self, of: Sequence[int]) -> np.ndarray:
        """The tree's value in each cell of these of its columns (by place), the others averaged."""
        of = list(of)
        dims = [len(self.cuts[j]) + 1 for j in of]
        if len(of) == len(self.columns):  # boxes don't overlap
            out = np.zeros(dims)
            for low, high, v in zip(self.low.tolist(), self.high.tolist(), self.value.tolist()):
                out[tuple(map(slice, low, high))] = v
            return out
        rest = [j for j in range(len(self.columns)) if j not in of]
        v = self.value * self.cold[:, rest].prod(1)
        wide = [d + 1 for d in dims]
        at, step = [], []
        for ends in product((0, 1), repeat=len(of)):  # a box is the running sum of its signed corners
            corner = [(self.high if e else self.low)[:, j] for e, j in zip(ends, of)]
            at.append(np.ravel_multi_index(corner, wide) if of else np.zeros(len(v), int))
            step.append(v * (-1) ** sum(ends))
        out = np.bincount(np.concatenate(at), np.concatenate(step), math.prod(wide)).reshape(wide)
        for axis in range(len(of)):
            out = out.cumsum(axis)
        return np.ascontiguousarray(out[tuple(slice(0, d) for d in dims)])


class Codes:
    """Rows by their place among all cuts of a forest, column by column; a tree's bins follow from a short table."""

    def __init__(self, x: np.ndarray, boxes: Iterable[Boxes]) -> None:
        of: dict[int, list] = {}
        for b in boxes:
            for c, cuts in zip(b.columns, b.cuts):
                of.setdefault(c, []).append(cuts)
        self.cuts = {c: np.unique(np.concatenate(v)) for c, v in of.items()}
        self.rows = {c: np.searchsorted(v, x[:, c], "left") for c, v in self.cuts.items()}

    def bins(self, b: Boxes) -> list[np.ndarray]:
        """For each column of a tree: the bin of each place among the forest's cuts."""
        return [np.append(np.searchsorted(cuts, self.cuts[c], "left"), len(cuts)) for c, cuts in zip(b.columns, b.cuts)]


def _blocks(n: int) -> Iterator[slice]:
    for lo in range(0, n, BLOCK):
        yield slice(lo, min(n, lo + BLOCK))


def add_predictions(out: np.ndarray, x: np.ndarray, forest: Sequence[dict]) -> list[dict]:
    """Adds the trees' weighted values to ``out``, tree by tree; the trees whose grids are too large are returned."""
    boxes = [Boxes(t) for t in forest]
    small = [b for b in boxes if b.cells <= CELLS]
    codes = Codes(x, small)
    for b in small:
        if not b.columns:
            out += b.value[0]
            continue
        flat, stride, maps = b.table(range(len(b.columns))), 1, []
        for j, m in reversed(list(enumerate(codes.bins(b)))):
            maps.append((codes.rows[b.columns[j]], m * stride))
            stride *= len(b.cuts[j]) + 1
        flat = flat.ravel()
        for s in _blocks(len(x)):
            at = maps[0][1].take(maps[0][0][s])
            for rows, m in maps[1:]:
                at += m.take(rows[s])
            out[s] += flat.take(at)
    return [t for t, b in zip(forest, boxes) if b.cells > CELLS]


def contributions(x: np.ndarray, forest: Sequence[dict]) -> tuple[np.ndarray, list[dict]]:
    """Shapley values ``[rows, columns]`` of path-dependent tree expectations, and the trees that are left to do by leaves.

    A value is a weighted sum, over sets of columns, of the forest's value with only those known. Each set's value is summed over
    trees first: in a table of all the forest's cells, where they are few, or by row.
    """
    n, p = x.shape
    boxes = [Boxes(t) for t in forest]
    small = [b for b in boxes if b.cells <= CELLS and len(b.columns) <= COLUMNS]
    codes = Codes(x, small)
    used = sorted(codes.cuts)
    phi = np.zeros((n, p))
    left = [t for t, b in zip(forest, boxes) if not (b.cells <= CELLS and len(b.columns) <= COLUMNS)]
    if not used or len(used) > COLUMNS:
        return phi, [*forest] if used else left
    dims = {c: len(codes.cuts[c]) + 1 for c in used}
    sets = [s for k in range(1, len(used) + 1) for s in combinations(used, k)]
    whole = {s: math.prod(dims[c] for c in s) * 2 <= n for s in sets}  # fewer cells than rows
    sums = {s: np.zeros([dims[c] for c in s]) if whole[s] else np.zeros(n) for s in sets}
    nothing = 0.0
    for b in small:
        maps, size = dict(zip(b.columns, codes.bins(b))), {c: len(v) + 1 for c, v in zip(b.columns, b.cuts)}
        nothing += float((b.value * b.cold.prod(1)).sum())
        tables: dict[tuple, np.ndarray] = {}
        by_row = []
        for s in sets:
            own = tuple(c for c in s if c in maps)  # columns that the tree lacks change nothing
            if own not in tables:
                tables[own] = b.table([b.columns.index(c) for c in own])
            if whole[s]:
                grid = tables[own][np.ix_(*[maps[c] for c in own])] if own else tables[own]
                sums[s] += grid.reshape([dims[c] if c in maps else 1 for c in s])
            elif own:
                by_row.append((sums[s], own, tables[own].ravel()))
            else:
                sums[s] += float(tables[own].ravel()[0])
        for r in _blocks(n) if by_row else ():
            at = {c: maps[c].take(codes.rows[c][r]) for c in maps}
            known = {(c,): v for c, v in at.items()}
            for total, own, flat in by_row:
                for k in range(2, len(own) + 1):
                    if own[:k] not in known:
                        known[own[:k]] = known[own[: k - 1]] * size[own[k - 1]] + at[own[k - 1]]
                total[r] += flat.take(known[own])
    value = {(): nothing}
    for s in sets:
        value[s] = sums.pop(s)
        if whole[s]:
            value[s] = value[s][tuple(codes.rows[c] for c in s)]
    m = len(used)
    for c in used:
        for s, v in value.items():
            k = len(s)
            w = math.factorial(k - 1) * math.factorial(m - k) if c in s else -math.factorial(k) * math.factorial(m - 1 - k)
            phi[:, c] += w / math.factorial(m) * v
    return phi, left


def chunks(batches: Iterable[pd.DataFrame], rows: int = CHUNK) -> Iterator[pd.DataFrame]:
    """Batches joined to about so many rows."""
    keep_memory()
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)
