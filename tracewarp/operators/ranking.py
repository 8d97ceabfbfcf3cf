"""Ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    """A number below 2^32 that a text decides."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def drawn(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn with replacement, with ``draw`` from 0: each draw's hash picks a rank by a unique numeric key, so the same seed draws the
    same rows however they are partitioned. An empty table gives no draws."""
    ranked = ordered_rank(rows, key, "_rank")
    size = rows.agg(F.count(F.lit(1)).alias("_size"))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(_number(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), size.scalar()) + 1).alias("_rank"))
    return draws.join(ranked, "_rank").drop("_rank")


def shuffled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, or all if there are fewer, in an order that the seed decides: the first by a hash of the key."""
    return rows.orderBy(_number(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def ordered_rank(rows: DataFrame, key: str, name: str = "rank", ranges: int = 200) -> DataFrame:
    """rows with their 1-based rank by a numeric key: rank within one of ``ranges`` ranges of the key plus the sizes of the ranges before.

    Only the cuts, at most ``ranges`` numbers, pass the driver. Null keys come first; rows with equal keys share a range.
    """
    share = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx(key, share, 10 * ranges).alias("c")).first()["c"] or []
    cuts = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    part = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c < F.col(key))))
    placed = rows.withColumn("_part", part)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, within + F.col("_before")).drop("_part", "_before")
