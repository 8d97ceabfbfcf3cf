"""Signals as arrays: decoding, normalisation, stall end, as higher-order functions without a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode(raw: Column, offset: Column, span: Column, digitisation: Column, low: float = 30.0, high: float = 200.0) -> Column:
    """Raw samples as picoampere; those outside the open interval are left out."""
    return F.filter(F.transform(raw, lambda x: (x + offset) * span / digitisation), lambda y: (y > low) & (y < high))


def bound(c: Column, body) -> Column:
    """body(c) with c computed once."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def mean(a: Column) -> Column:
    """The mean of an array; null for an empty one."""
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def zscore(a: Column) -> Column:
    """Population z-scores; zeros where the signal is constant, whatever the rounding of its mean."""

    def body(m):
        sd = F.when(F.array_min(a) < F.array_max(a), F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m)))))
        return bound(sd, lambda s: F.transform(a, lambda x: F.when(s > 0, (x - m) / s).otherwise(0.0)))

    return bound(mean(a), body)


def discrete_normalize(a: Column, reach: int = 4, levels: int = 256) -> Column:
    """Integer levels: whole mean and whole mean deviation, clipped at +-reach deviations, truncated."""

    def body(m):
        mad = F.greatest(mean(F.transform(a, lambda x: F.abs(x - m))).cast("long"), F.lit(1))
        return bound(mad, lambda d: F.transform(a, lambda x: ((F.greatest(F.least((x - m) / d, F.lit(float(reach))), F.lit(float(-reach))) + reach) * levels / (2 * reach)).cast("long")))

    return bound(mean(a).cast("long"), body)


def expanding_levels(x: np.ndarray, block: int = 20, reach: int = 4, levels: int = 256) -> np.ndarray:
    """discrete_normalize() of each block of samples by the whole mean and deviation of all samples up to its end. A mean's sum runs from the
    first sample on, a deviation's from the last one back, as the joins of its SQL do, so their rounding doesn't hang on how rows meet. A
    missing sample (NaN) counts for no mean and has the top level."""
    known = ~np.isnan(x)
    ends = np.minimum(np.arange(block, len(x) + block, block), len(x)) - 1
    n = np.cumsum(known)[ends]
    some = n > 0
    mu, mad = np.zeros(len(ends)), np.ones(len(ends))
    mu[some] = np.trunc(np.cumsum(np.where(known, x, 0.0))[ends[some]] / n[some])
    for m in np.unique(mu[some]):  # whole means are few, however many blocks there are
        at = np.flatnonzero(some & (mu == m))
        size = np.where(known, np.abs(x - m), 0.0)
        mean = np.cumsum(size)[ends[at]] / n[at]
        for k in np.flatnonzero(np.abs(mean - np.round(mean)) <= n[at] * mean * 2.0**-51):  # only there the order of a sum matters
            mean[k] = np.cumsum(size[ends[at[k]] :: -1])[-1] / n[at[k]]
        mad[at] = np.maximum(np.trunc(mean), 1.0)
    of = np.arange(len(x)) // block
    z = np.where(known, (x - mu[of]) / mad[of], float(reach))
    return np.trunc((np.maximum(np.minimum(z, float(reach)), float(-reach)) + reach) * levels / (2 * reach)).astype(np.int64)


def expanding_normalize(a: Column, block: int = 20) -> Column:
    """expanding_levels() of an array, in Arrow batches."""

    @F.pandas_udf("array<long>")
    def run(signals: pd.Series) -> pd.Series:
        return signals.map(lambda x: None if x is None else expanding_levels(np.asarray(x, float), block))

    return run(a)


def stall_end(a: Column, high: float = 3.0, width: int = 3, times: int = 2) -> Column:
    """Where an initial stall ends, in steps of ``width`` samples: after ``times`` means in a row above, and then as many in a row below.
    The last mean may be of fewer samples. Without a stall, or without its end, the place after the last mean, so that nothing is left."""
    n = F.ceil(F.size(a) / width).cast("int")
    means = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean(F.slice(a, i * width + 1, F.lit(width))))).otherwise(F.array().cast("array<double>"))
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("phase"))

    def step(s, m):
        run = F.when(F.when(s["phase"] == 0, m > high).otherwise(m < high), s["run"] + 1).otherwise(0)
        moved = F.struct((s["at"] + 1).alias("at"), F.when(run == times, 0).otherwise(run).alias("run"), F.when(run == times, s["phase"] + 1).otherwise(s["phase"]).alias("phase"))
        return F.when(s["phase"] == 2, s).otherwise(moved)

    return F.aggregate(means, state, step, lambda s: s["at"] * width)


def chunks(a: Column, size: int) -> Column:
    """A signal in consecutive slices of at most size samples."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(a, s + 1, F.lit(size)))


def limited(x: np.ndarray, limit: float = 4.0, near: float = 3.0) -> np.ndarray:
    """A signal without samples beyond the limit, first above and then below: one whose right neighbour is beyond ``near``, or whose left
    one (as already changed) is beyond the limit, is clipped; others become the mean of their neighbours, or the only one's value."""
    x = x.copy()
    for sign in (1.0, -1.0):
        x *= sign
        for i in np.flatnonzero(x > limit):
            after, before = x[i + 1 : i + 2], x[i - 1 : i] if i else x[:0]
            crowd = (after > near).any() or (before > limit).any()
            x[i] = limit if crowd or len(x) == 1 else np.concatenate([before, after]).mean()
        x *= sign
    return x


def limit_outliers(a: Column, limit: float = 4.0, near: float = 3.0) -> Column:
    """limited() of an array, in Arrow batches: only its outliers are walked."""

    @F.pandas_udf("array<double>")
    def run(signals: pd.Series) -> pd.Series:
        return signals.map(lambda x: None if x is None else limited(np.asarray(x, float), limit, near))

    return run(a)


def interpolated(points: DataFrame, places: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """places (key, x) with y, on the straight line between the points (key, x, y) around it; beyond the ends, the end's y. Points and
    places meet in one sorted pass over a key. A key without points gives null; of points with equal x the smallest y counts."""
    at = points.where(F.col(x).isNotNull()).groupBy(key, x).agg(F.min(y).alias("_y"))
    both = at.select(key, F.col(x).alias("_x"), F.col("_y"), F.lit(0).alias("_place")).unionByName(places.select(key, F.col(x).alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_place")))
    order = Window.partitionBy(key).orderBy("_x", "_place")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("_place") == 0, F.struct("_x", "_y"))
    rows = both.withColumns({"low": F.last(point, True).over(before), "high": F.first(point, True).over(after)}).where("_place = 1")
    inner = F.col("low._y") + (F.col("_x") - F.col("low._x")) * (F.col("high._y") - F.col("low._y")) / (F.col("high._x") - F.col("low._x"))
    line = F.when(F.col("low").isNull(), F.col("high._y")).when(F.col("high").isNull() | (F.col("low._x") == F.col("_x")), F.col("low._y")).otherwise(inner)
    return rows.select(key, F.col("_x").alias(x), line.alias(y))
