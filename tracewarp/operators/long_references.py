"""References too long for a row: signals and index from tiles of sequences, equal to those of whole ones.

Levels need a tile's letters and the next k - 1. Their mean and deviation are sums over tiles. Which events change enough to be kept depends on
the last one kept before, from tile to tile: each tile is folded from a guess of it, and again where the tile before has ended
otherwise, until no guess is wrong, mostly after one more round as folds forget where they started. Kept events are numbered by the
tiles' counts and dealt anew into tiles with as many neighbours on both sides as seeds and minimizers reach.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MapOptions
from ..functions.seq import revcomp
from ..functions.sketch import kept_events, minimizers, seeds
from ..sources.files import overlapping
from .expected import level_list, lookup

KEYS = ["ref_id", "strand"]


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tiled_signals(tiles: DataFrame, model: DataFrame, k: int, folder: str) -> DataFrame:
    """(ref_id, strand, start, signal): z-scored levels of both strands of references in tiles (ref_id, at, seq), whose seq has the next k - 1
    letters of the following tile too. Only whole-reference sums are shuffled; ``folder`` is shared by all executors."""
    own = tiles.select("ref_id", "at", "seq", level_list(model, k).scalar().alias("levels")).where(F.char_length("seq") >= k)
    places = F.char_length("seq") - (k - 1)
    raw = _written(own.select("ref_id", "at", places.alias("n"), F.explode(F.array(F.struct(F.lit(0).alias("strand"), lookup(F.col("seq"), F.col("levels"), k).alias("x")), F.struct(F.lit(1).alias("strand"), lookup(revcomp(F.col("seq")), F.col("levels"), k).alias("x")))).alias("s")).select("ref_id", "at", "n", "s.strand", "s.x"), folder, "levels")
    total = lambda f: F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + f(v)))
    mean = raw.groupBy(*KEYS).agg((total(lambda v: v) / F.sum("n")).alias("mean"), F.sum("n").alias("size"), (F.min(F.array_min("x")) < F.max(F.array_max("x"))).alias("varied"))
    around = raw.join(F.broadcast(mean) if mean.limit(10_001).count() <= 10_000 else mean, KEYS)
    spread = around.groupBy(*KEYS).agg(F.sqrt(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))) / F.first("size")).alias("sd"))  # of a constant signal only rounding
    rows = around.join(F.broadcast(spread) if spread.limit(10_001).count() <= 10_000 else spread, KEYS)
    start = F.when(F.col("strand") == 0, F.col("at")).otherwise(F.col("size") - F.col("at") - F.col("n"))
    return rows.select(*KEYS, start.cast("long").alias("start"), F.transform("x", lambda v: F.when(F.col("varied") & (F.col("sd") > 0), (v - F.col("mean")) / F.col("sd")).otherwise(0.0)).alias("signal"))


def kept_in_tiles(signals: DataFrame, least: float, folder: str, rounds: int = 1000) -> DataFrame:
    """(ref_id, strand, start, kept: (pos in the reference, value)) of signals (ref_id, strand, start, signal) in tiles: the events that
    kept_events() keeps of whole signals."""
    rows = _written(signals, folder, "signals")
    order = Window.partitionBy(*KEYS).orderBy("start")
    guess = F.lag(F.element_at("signal", -1)).over(order)  # the last event before is as good a guess as any
    todo, done = rows.withColumn("last", guess), None
    for _ in range(rounds):
        kept = kept_events(F.col("signal"), least, last=F.col("last"))
        new = todo.select(*KEYS, "start", "last", F.transform(kept, lambda x: F.struct((F.col("start") + x["pos"]).alias("pos"), x["value"].alias("value"))).alias("kept"))
        merged = new if done is None else new.unionByName(done.join(todo.select(*KEYS, "start"), [*KEYS, "start"], "left_anti"))
        done = _written(merged, folder, "kept")
        ends = done.select(*KEYS, "start", "last", F.coalesce(F.element_at("kept.value", F.when(F.size("kept") > 0, -1)), F.col("last")).alias("end"))
        right = ends.withColumn("right", F.lag("end").over(order)).where(~F.col("right").eqNullSafe(F.col("last"))).select(*KEYS, "start", F.col("right").alias("last"))
        wrong = _written(right, folder, "wrong")  # a row a tile
        if wrong.isEmpty():
            return done.select(*KEYS, "start", "kept")
        todo = rows.join(wrong, [*KEYS, "start"]).select(*rows.columns, "last")
    raise ValueError("tiles don't agree on the events between them")


def index_of_tiles(signals: DataFrame, o: MapOptions, folder: str, size: int = 1 << 16) -> DataFrame:
    """build_index() of references whose signals come in tiles: (hash, ref_id, strand, t), the same rows as for whole signals."""
    if o.least_change is None:
        every = F.transform("signal", lambda x, i: F.struct((F.col("start") + i).alias("pos"), x.cast("double").alias("value")))
        kept = _written(signals.select(*KEYS, "start", every.alias("kept")), folder, "kept")
    else:
        kept = kept_in_tiles(signals, o.least_change, folder)
    past = Window.partitionBy(*KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = kept.withColumns({"n": F.size("kept"), "first": F.coalesce(F.sum(F.size("kept")).over(past), F.lit(0))})
    back, ahead = o.e - 1 + max(0, o.w - 1), o.e - 1 + max(0, o.w - 1)
    tiles = overlapping(numbered, KEYS, "first", "n", size, back, ahead)
    part = F.struct((F.col("first") + F.col("low")).alias("at"), F.slice("kept", F.col("low") + 1, F.col("high") - F.col("low")).alias("kept"))
    lists = tiles.groupBy(*KEYS, "tile").agg(F.array_sort(F.collect_list(part)).alias("p"))
    lists = lists.select(*KEYS, "tile", F.get("p", F.lit(0))["at"].alias("at"), F.flatten(F.transform("p", lambda x: x["kept"])).alias("kept"))
    values = F.transform("kept", lambda x: x["value"])
    found = lists.select(*KEYS, "tile", "at", "kept", F.explode(minimizers(values, o.e, o.w) if o.w else seeds(values, o.e)).alias("s"))
    number = F.col("at") + F.col("s.pos")
    mine = found.where((number >= F.col("tile") * size) & (number < (F.col("tile") + 1) * size))
    return mine.select(F.col("s.hash").alias("hash"), *KEYS, F.get("kept", F.col("s.pos"))["pos"].cast("int").alias("t"))
