"""Dynamic time warping over Arrow batches: all pairs of a batch go through one numpy recurrence together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matrix cells that a helper holds for one row of the recurrence; longer batches are cut into blocks of pairs.
BLOCK = 1_000_000


def _padded(signals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in signals])
    out = np.zeros((len(signals), max(1, sizes.max(initial=1))))
    for k, x in enumerate(signals):
        out[k, : len(x)] = x
    return out, sizes


def antidiagonal_band(rows: int, columns: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest row of the band on each antidiagonal, for at least as many rows as columns.

    A step down moves the band's centre to the next row, and to the next column where the slanted diagonal gets there. The
    antidiagonals through these centres have the odd one of r and r + 1 cells; where both move, the one in between has the even
    number. r is the radius and its share of the difference of the lengths, rounded up.
    """
    r = radius + -(-(rows - columns) * radius // rows)
    odd, even = (r, r + 1) if r % 2 else (r + 1, r)
    row = np.arange(rows)
    column = columns * row // rows
    low, high = np.zeros(rows + columns - 1, int), np.full(rows + columns - 1, -1)
    low[row + column], high[row + column] = row - odd // 2, row + odd // 2
    both = np.flatnonzero(np.diff(column, prepend=0))
    between = row[both] + column[both] - 1
    low[between], high[between] = row[both] - even // 2, row[both] + even // 2 - 1
    return low, high


def warp_many(a: list[np.ndarray], b: list[np.ndarray], free: bool = False, radius: int | None = None, slanted: bool = True, antidiagonal: bool = False) -> np.ndarray:
    """Costs of aligning each a with its b (or, if free, with the best part of b); steps right, down and both, L1 cost.

    A band takes the longer signal as rows and keeps the columns within radius of floor(columns * row / rows); radius grows
    with the difference of the lengths, so that the corner stays in reach. A band that isn't slanted keeps the columns within
    radius of the row itself, and costs infinity if the corner is outside. An antidiagonal band keeps the cells of
    antidiagonal_band(). Filling beyond a signal's end never reaches the cells before it. An empty signal costs infinity.
    """
    if radius is not None and antidiagonal and not free:
        out = np.full(len(a), np.inf)
        shapes, of = np.unique([(len(x), len(y)) for x, y in zip(a, b, strict=True)], axis=0, return_inverse=True)
        for k, (n, m) in enumerate(shapes.tolist()):
            at = np.flatnonzero(of.reshape(-1) == k)
            if n and m:
                out[at] = warp_alike(np.array([a[i] for i in at], float).T, np.array([b[i] for i in at], float).T, radius)
        return out
    if radius is not None and not free:
        a, b = zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True)
    (left, rows), (right, columns) = _padded(list(a)), _padded(list(b))
    out, cols, every = np.full(len(rows), np.inf), np.arange(right.shape[1]), np.arange(len(rows))
    reach = None if radius is None else radius + np.ceil(np.maximum(0, rows - columns) * radius / np.maximum(rows, 1)) * slanted
    row = np.full(right.shape, np.inf)
    for i in range(left.shape[1]):
        cost = np.abs(left[:, i, None] - right)
        best = np.minimum(row, np.concatenate([np.full((len(rows), 1), np.inf), row[:, :-1]], 1)) + cost
        if i == 0:
            best = cost.copy()
            if not free:
                best[:, 1:] = np.inf
        centre = columns * i // np.maximum(rows, 1) if slanted else np.full(len(rows), i)
        inside = None if reach is None else np.abs(cols - centre[:, None]) <= reach[:, None]
        if inside is not None:
            best = np.where(inside, best, np.inf)
        # right steps: the smallest best[k] + cost[k+1..j] is a running minimum against the summed costs; a row's cells in a band are adjacent
        total = cost.cumsum(1)
        row = np.minimum.accumulate(best - total, 1) + total
        if inside is not None:
            row = np.where(inside, row, np.inf)
        done = (rows == i + 1) & (columns > 0)
        if done.any():
            ends = np.where(cols < columns[:, None], row, np.inf).min(1) if free else row[every, np.maximum(columns - 1, 0)]
            out[done] = ends[done]
    return out


def warp_alike(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> np.ndarray:
    """Costs of pairs of equal lengths, a column of a with a column of b each, in the antidiagonal band of ``radius`` (None: over the whole matrix)."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    d = np.arange(n + m - 1)
    low, high = (0 * d, d) if radius is None else antidiagonal_band(n, m, radius)
    low, high = np.maximum(np.maximum(low, d - m + 1), 0).tolist(), np.minimum(np.minimum(high, d), n - 1).tolist()
    step, parts = max(1, BLOCK // (4 * n)), []
    for k in range(0, a.shape[1], step):
        x, y = a[:, k : k + step], b[::-1, k : k + step]  # so that the cells of an antidiagonal are slices of both
        lines = [np.full((n + 1, x.shape[1]), np.inf) for _ in range(3)]  # of the cells (i, d - i), i has the place i + 1
        for d, (i, j) in enumerate(zip(low, high, strict=True)):
            now, last, before = lines[d % 3], lines[(d - 1) % 3], lines[(d - 2) % 3]
            if d >= 3:
                now[low[d - 3] + 1 : high[d - 3] + 2] = np.inf
            if i > j:
                continue
            cost = np.abs(x[i : j + 1] - y[m - 1 - d + i : m - d + j])
            if d:
                least = np.minimum(last[i : j + 1], last[i + 1 : j + 2])
                cost += np.minimum(least, before[i : j + 1], out=least)
            now[i + 1 : j + 2] = cost
        parts.append(now[n].copy())
    return np.concatenate(parts)


def warp(a: np.ndarray, b: np.ndarray, free: bool = False, radius: int | None = None, antidiagonal: bool = False) -> float:
    return float(warp_many([a], [b], free, radius, True, antidiagonal)[0])


def bonus_many(s: list[np.ndarray], r: list[np.ndarray], bonus: float = 10.0, most: int = 10) -> np.ndarray:
    """Best costs of each s in its r where no reference sample may be skipped; leaving a reference sample earns a bonus for each sample spent on it."""
    (left, rows), (right, columns) = _padded(s), _padded(r)
    every, end = np.arange(len(rows)), np.maximum(rows - 1, 0)
    col = np.abs(left - right[:, :1]).cumsum(1)
    stay = np.zeros(left.shape)
    best = np.where((rows > 0) & (columns > 0), col[every, end], np.inf)
    for j in range(1, right.shape[1]):
        new, held = np.zeros(left.shape), np.zeros(left.shape)
        leave = col - bonus * stay
        gap = np.abs(left - right[:, j, None])
        for i in range(1, left.shape[1]):
            quit_ = leave[:, i - 1] < new[:, i - 1]
            new[:, i] = np.where(quit_, leave[:, i - 1], new[:, i - 1]) + gap[:, i]
            held[:, i] = np.where(quit_, 0, np.minimum(most, stay[:, i] + 1))
        col, stay = new, held
        best = np.where(j < columns, np.minimum(best, col[every, end]), best)
    return best


def path(a: np.ndarray, b: np.ndarray, free: bool = False) -> tuple[float, list[tuple[int, int, float]]]:
    """Cost and cells (i, j, difference) of the best alignment; equal costs prefer the diagonal, then the step down."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("inf"), []
    gap, c = np.abs(np.subtract.outer(a, b)), np.full((n + 1, m + 1), np.inf)
    c[0, :] = 0 if free else np.inf
    c[0, 0] = 0
    for d in range(n + m - 1):  # antidiagonals, as the cells of one don't depend on each other
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        c[i + 1, j + 1] = gap[i, j] + np.minimum(np.minimum(c[i, j + 1], c[i + 1, j]), c[i, j])
    i, j = n, int(c[n, 1:].argmin()) + 1 if free else m
    cost, cells = float(c[i, j]), []
    while i > 0 and j > 0:
        cells.append((i - 1, j - 1, float(gap[i - 1, j - 1])))
        if free and i == 1:
            break
        diagonal, down, right = c[i - 1, j - 1], c[i - 1, j], c[i, j - 1]
        if right < down and right < diagonal:
            j -= 1
        elif down < diagonal:
            i -= 1
        else:
            i, j = i - 1, j - 1
    return cost, cells[::-1]


def _blocks(a: list[np.ndarray], b: list[np.ndarray]):
    """Places of pairs in blocks of like lengths and at most BLOCK cells a row."""
    order = np.argsort([len(x) for x in a], kind="stable")
    wide = max((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), default=1)
    step = max(1, BLOCK // max(1, wide))
    return [order[k : k + step] for k in range(0, len(order), step)]


def batch_costs(a: list, b: list, kind: str = "global", radius: int | None = None) -> np.ndarray:
    """Costs of pairs, block by block; an empty or missing signal costs infinity."""
    left, right = ([np.asarray([] if x is None else x, float) for x in s] for s in (a, b))
    out = np.full(len(left), np.inf)
    for at in _blocks(left, right):
        x, y = [left[k] for k in at], [right[k] for k in at]
        out[at] = bonus_many(x, y) if kind == "bonus" else warp_many(x, y, kind == "free", radius, kind != "diagonal", kind == "antidiagonal")
    return out


def pairs_cost(pairs: DataFrame, kind: str = "global", radius: int | None = None) -> DataFrame:
    """pairs with columns a and b (arrays) and their cost; other columns stay. Rows are independent, so nothing is shuffled."""

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(batch_costs(list(a), list(b), kind, radius))

    return pairs.withColumn("cost", cost("a", "b"))


def pairs_path(pairs: DataFrame, free: bool = False) -> DataFrame:
    """pairs with cost and path, an array of (i, j, d)."""

    @F.pandas_udf("cost double, path array<struct<i:int,j:int,d:double>>")
    def trace(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [path(np.asarray(x, float), np.asarray(y, float), free) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"cost": [c for c, _ in found], "path": [[{"i": i, "j": j, "d": d} for i, j, d in p] for _, p in found]})

    return pairs.withColumn("_r", trace("a", "b")).select("*", "_r.cost", "_r.path").drop("_r")


def against(reads: DataFrame, targets: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Every read with every target. Targets whose arrays have ``most`` bytes at most are broadcast; more of them meet the reads partition
    by partition, as the result is every pair in any case."""
    arrays = [c for c, kind in targets.dtypes if kind.startswith("array")]
    held = targets.agg(F.sum(sum((F.size(c) for c in arrays), F.lit(1)) * 8).alias("n")).first()["n"] or 0
    return reads.crossJoin(F.broadcast(targets) if held <= most else targets)
