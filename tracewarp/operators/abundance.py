"""Abundance by ticks, and when it or the coverage is settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import bound


def tick_distances(step: DataFrame, limit: float, back: int = 4) -> DataFrame:
    """(tick, distance, stop) of rows (tick, k, b), the bases that a tick adds to organism k.

    distance is the largest squared distance of the running shares from those of the ``back`` ticks before; stop says that all
    of these are there and none is over the limit. Rows are few: one for each tick and organism.
    """
    ticks, keys = step.select("tick").distinct(), step.select("k").distinct()
    grid = ticks.join(keys).join(step, ["tick", "k"], "left")  # an organism keeps its sum in ticks without it
    past, gaps = Window.partitionBy("k").orderBy("tick"), [f"d{i}" for i in range(1, back + 1)]
    run = grid.withColumn("total", F.sum(F.coalesce("b", F.lit(0.0))).over(past))
    share = run.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy("tick")))
    far = share.select("tick", *(F.pow(F.col("share") - F.lag("share", i).over(past), 2).alias(d) for i, d in enumerate(gaps, 1)))
    sums = far.groupBy("tick").agg(*(F.sum(d).alias(d) for d in gaps))
    worst = F.greatest(*gaps)
    stop = F.coalesce(F.col(gaps[-1]).isNotNull() & (worst <= limit), F.lit(False))
    return sums.select(F.col("tick").cast("long").alias("tick"), F.round(worst, 9).alias("distance"), stop.alias("stop"))


def greedy_outlier(vectors: Column) -> Column:
    """The largest squared distance met when each vector in turn is compared with the farthest one so far, starting from the first."""

    def step(s, v):
        far = F.aggregate(F.zip_with(v, s["at"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
        return bound(far, lambda d: F.struct(F.when(d > s["far"], v).otherwise(s["at"]).alias("at"), F.greatest(d, s["far"]).alias("far")))

    start = F.struct(F.get(vectors, F.lit(0)).alias("at"), F.lit(0.0).alias("far"))
    return F.aggregate(vectors, start, step, lambda s: s["far"])


def shares_by_tick(step: DataFrame) -> DataFrame:
    """(tick, shares) of rows (tick, k, b), with ticks 1, 2, ...: after every tick the share of each organism, in order of k."""
    ends = step.groupBy().agg(F.max("tick").alias("last"), F.sort_array(F.collect_set("k")).alias("ks"))  # references, not reads
    past = Window.partitionBy("k").orderBy("tick")
    sums = step.select("k", "tick", F.sum("b").over(past).alias("total"), F.lead("tick").over(past).alias("next"))
    runs = sums.withColumn("end", F.coalesce(F.col("next") - 1, ends.select("last").scalar())).select("k", "total", F.explode(F.sequence("tick", "end")).alias("tick"))
    maps = runs.groupBy("tick").agg(F.map_from_entries(F.collect_list(F.struct("k", "total"))).alias("m"), F.sum("total").alias("all"))
    maps = maps.withColumn("ks", ends.select("ks").scalar())
    return maps.select("tick", F.transform("ks", lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("all")).alias("shares"))


def ring_distances(step: DataFrame, limit: float, ring: int = 5) -> DataFrame:
    """(tick, distance, stop): the outlier distance among the last ``ring`` ticks' shares, which lie in slots that are reused in turn
    (that order decides whom the greedy pass compares). A tick stops if as many ticks went before and the distance is within the limit.
    """
    shares = shares_by_tick(step)
    held = shares.select(F.explode(F.sequence(F.col("tick"), F.col("tick") + ring - 1)).alias("at"), F.struct(((F.col("tick") - 1) % ring).alias("slot"), "shares").alias("x"))
    rows = held.join(shares.select(F.col("tick").alias("at")), "at").groupBy("at").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    distance = greedy_outlier(F.transform("xs", lambda x: x["shares"]))
    rows = rows.select(F.col("at").cast("long").alias("tick"), distance.alias("distance"))
    return rows.select("tick", F.round("distance", 12).alias("distance"), ((F.col("tick") > ring) & (F.col("distance") <= limit)).alias("stop"))


def region_coverage(mapped: DataFrame, refs: DataFrame, width: int) -> DataFrame:
    """(ref_id, region, bases, coverage) of every region of ``width`` places of refs (ref_id, length), covered or not.

    mapped has (ref_id, t_start, t_end), both ends included. A mapping counts in every region that it touches.
    """
    region = F.explode(F.sequence(F.floor(F.col("t_start") / width), F.floor(F.col("t_end") / width))).alias("region")
    parts = mapped.where("t_end >= t_start").select("ref_id", "t_start", "t_end", region)
    inside = F.least("t_end", (F.col("region") + 1) * width - 1) - F.greatest("t_start", F.col("region") * width) + 1
    sums = parts.groupBy("ref_id", "region").agg(F.sum(inside).alias("bases"))
    every = refs.where("length > 0").select("ref_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / width))).alias("region"))
    size = F.least(F.lit(width), F.col("length") - F.col("region") * width)
    rows = every.join(sums, ["ref_id", "region"], "left").withColumn("bases", F.coalesce("bases", F.lit(0).cast("long")))
    return rows.select("ref_id", "region", "bases", (F.col("bases") / size).alias("coverage"))
