"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Rows of a source are numbered and cut into blocks. A fluid schedule serves all sources at once in proportion to their
weights; a source that runs out leaves its part to the others. Block j of source i lies in it between virtual times j / w
and (j + 1) / w, and by virtual time v the fluid schedule has served sum over k of min(w[k] v, blocks[k]) slots. A block is
released at the floor of that sum at its start and due at the ceiling of that at its end; each slot goes to the released
block that is due first. Weights are whole numbers (shares of 2 ** 40), so releases and deadlines are exact, and no
remainder is lost however long the schedule is: at every slot a source has had its fluid share within less than one
block. No slot stays empty. Every row is scheduled once: none is dropped or repeated.

The schedule has at most about ``most_slots`` slots: blocks hold ``block`` rows, and more where the table has more rows than
that. So that long blocks mix as finely as short ones, the rows of ``STRIPE`` successive slots take turns: the first row of
each, then the second of each, and so on. place is that order.

Numbers inside a source come from buckets of its rows, so that a source with a third of all rows isn't one task: a row
number within (source, bucket) plus the sizes of the buckets before it. Their number follows the table's size. Where
there are more than ``most_sources`` sources, those with the smallest weights share one queue. What the fluid schedule has
served it by virtual time v is the sum of min(w[k] v, rows[k]) over its own sources, so it slows down as they run out one
by one; its blocks lie between the times at which that sum passes whole blocks, and these times go into the same exact
schedule. The sum is exact at ``CUTS`` times and linear between. The queue's rows stand in the order of their own virtual
times, each source beginning at a phase of its own, and are numbered through buckets of that time. So the queue is less than
a block off its share, like any source, and each of its sources follows it by rows (less than 1.25 blocks in the tests).

Defined results: rows with a null source are a source of their own; repeated rows are numbered one by one; ties are
broken by doc_id and then by the hash of the text; sources without a given weight get ``others``; weights of zero or
less are an error; an empty table gives an empty schedule; texts of any length are only hashed.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import unpacked, whole, written

SHARES, STRIPE, BUCKET_ROWS, CUTS, SCALE = 1 << 40, 1024, 100_000, 1 << 16, 1 << 100


def whole_weights(weights: list[float], scale: float | None = None) -> list[int]:
    """Weights as whole numbers, one at least: times scale, or so that they sum to about SHARES."""
    if any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scale = SHARES / math.fsum(weights) if scale is None else scale
    return [max(1, round(w * scale)) for w in weights]


def crossings(cuts: list[tuple[int, int, float]], last: float, size: int) -> list[float]:
    """Virtual times at which sources have had 1, 2, ... blocks of size rows together, the last one maybe short.

    cuts: (number, rows, weight) of the sources that end in a cut of the time up to last, when all have ended.
    """
    rows, left, points = 0, math.fsum(w for _, _, w in cuts), []
    for number, n, w in sorted(cuts):
        start, end = number / CUTS * last, (number + 1) / CUTS * last
        points.append((start, rows + start * left))
        rows, left = rows + n, max(left - w, 0.0)
        points.append((end, rows + end * left))
    time, served, out = 0.0, 0.0, []
    for then, now in points:  # without ends between two edges, the sum is linear
        while now > served and (len(out) + 1) * size <= now:
            out.append(time + ((len(out) + 1) * size - served) / (now - served) * (then - time))
        time, served = then, max(now, served)
    out = out[: rows // size]
    return out + [last] * (-(-rows // size) - len(out))


def schedule(weights: list[int], blocks: list[int], shared: list[float] = ()) -> list[tuple[int, int]]:
    """(source, block) of each slot: among the released blocks, the one due first. shared has the virtual times at which
    the blocks of one more queue, numbered len(weights), end."""
    order = sorted((i for i in range(len(weights)) if blocks[i]), key=lambda i: blocks[i] / weights[i])
    active, gone = [0] * (len(order) + 1), [0] * (len(order) + 1)  # weight still there, and blocks of those gone, after so many ends
    active[0] = sum(weights[i] for i in order)
    for k, i in enumerate(order):
        active[k + 1], gone[k + 1] = active[k] - weights[i], gone[k] + blocks[i]
    times = [0]  # of the shared queue's blocks, as whole numbers of 1 / SCALE
    for time in shared:
        times.append(max(int(time * SCALE), times[-1] + 1))
    queue, many = len(weights), len(shared)
    ended = dict.fromkeys([*order, queue], 0)

    def served(i: int, j: int) -> tuple[int, int]:
        """The fluid schedule's slots when source i has had j blocks, rounded down and up."""
        above, below = (j, weights[i]) if i < queue else (times[j], SCALE)  # the virtual time
        k = ended[i]
        while k < len(order) and order[k] != i and blocks[order[k]] * below <= above * weights[order[k]]:
            k += 1
        ended[i] = k
        b = bisect_right(times, above * SCALE // below) - 1 if many else 0
        over, under = above * active[k], below
        if b < many:
            step = times[b + 1] - times[b]
            over, under = over * step + above * SCALE - times[b] * below, below * step
        return gone[k] + b + over // under, gone[k] + b - (-over // under)

    blocks = [*blocks, many]
    released, due, out = [(0, i, 0) for i in ended if blocks[i]], [], []
    for t in range(sum(blocks)):
        while released and released[0][0] <= t:
            _, i, j = heapq.heappop(released)
            low, high = served(i, j + 1)
            heapq.heappush(due, (high, i, j, low))
        _, i, j, low = heapq.heappop(due)
        out.append((i, j))
        if j + 1 < blocks[i]:
            heapq.heappush(released, (low, i, j + 1))
    return out


def _numbered(rows: DataFrame, group: str, bucket: str, by: list[str], name: str) -> DataFrame:
    """rows with number: their place in their group, in the order of bucket and then of the columns by. Null is a group."""
    sizes = written(rows.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("n")), f"{name}-sizes")
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("og"), F.col(bucket).alias("ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = rows.withColumn("nth", F.row_number().over(Window.partitionBy(group, bucket).orderBy(*by)) - 1)
    both = inside.join(offsets, F.col(group).eqNullSafe(F.col("og")) & (F.col(bucket) == F.col("ob")))
    return both.select(*rows.columns, (F.col("ahead") + F.col("nth")).alias("number"))


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block: int = 8, others: float | None = None, most_slots: int = 1 << 20, most_sources: int = 4096) -> DataFrame:
    """doc_id, source, tie, block, nth (the row's place in its block), slot and place (the order of the mixed rows).

    Without weights, these are in proportion to a power of the sources' sizes: below 1, small sources gain.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = written(docs.select("doc_id", "source", tie.alias("tie")), "mix-rows")
    total = rows.count()
    buckets = max(64, math.ceil(total / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sources = sources.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "gs string, gw double")
        fill = others if others is not None else min(weights.values(), default=1.0)
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("gs")), "left").select("source", "n", F.coalesce("gw", F.lit(float(fill))).alias("weight"))
    sources = written(sources, "mix-sources")
    top = sources.orderBy(F.desc("weight"), "source").limit(most_sources).collect()
    size = max(block, math.ceil(total / most_slots))
    numbered = _numbered(rows, "source", "bucket", ["doc_id", "tie"], "mix")
    names = [(r["source"], i) for i, r in enumerate(top)]
    heavy = F.broadcast(spark.createDataFrame(names, "hs string, queue int"))  # most_sources rows at most
    rest = len(top)
    blocks, shares = [-(-r["n"] // size) for r in top], [r["weight"] for r in top]
    queued = numbered.join(heavy, F.col("source").eqNullSafe(F.col("hs")), "left").drop("hs", "bucket")
    scale, shared = SHARES / math.fsum(shares) if rest else 1.0, []
    if rest == most_sources:
        tail = sources.join(heavy, F.col("source").eqNullSafe(F.col("hs")), "left").where("queue is null").select(F.col("source").alias("ss"), "n", "weight")
        weight, last = tail.agg(F.sum("weight"), F.max(F.col("n") / F.col("weight"))).first()
        if weight is not None:
            scale = SHARES / (math.fsum(shares) + weight)
            cut = F.least(F.floor(F.col("n") / F.col("weight") / F.lit(last) * CUTS), F.lit(CUTS - 1))
            cuts = tail.groupBy(cut.alias("cut")).agg(F.sum("n"), F.sum("weight")).collect()  # CUTS rows at most
            shared = [time / size / scale for time in crossings([tuple(c) for c in cuts], last, size)]
            queued = written(queued, "mix-queued")
            phase = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)
            time = (F.col("number") + phase) / F.col("weight")
            many = queued.where("queue is null").join(tail, F.col("source").eqNullSafe(F.col("ss"))).withColumns({"time": time, "queue": F.lit(rest)})
            many = many.withColumn("span", F.least(F.floor(F.col("time") / F.lit(last) * buckets), F.lit(buckets - 1))).drop("ss", "n", "weight", "number")
            many = _numbered(many, "queue", "span", ["time", "doc_id", "tie"], "mix-tail").drop("time", "span")
            queued = queued.where("queue is not null").unionByName(many)
    slots = [(i, j, t) for t, (i, j) in enumerate(schedule(whole_weights(shares, scale), blocks, shared))] if top else []
    table = F.broadcast(spark.createDataFrame(slots, "sq int, sb long, slot long"))  # most_slots + most_sources + 1 rows at most
    queued = queued.withColumns({"block": F.floor(F.col("number") / size).cast("long"), "nth": F.pmod("number", F.lit(size)).cast("int")})
    placed = queued.join(table, (F.col("queue") == F.col("sq")) & (F.col("block") == F.col("sb")))
    place = (F.floor(F.col("slot") / STRIPE) * size + F.col("nth")) * STRIPE + F.pmod("slot", F.lit(STRIPE))
    return placed.select("doc_id", "source", "tie", "block", "nth", "slot", place.cast("long").alias("place"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs in the order of the schedule: range-partitioned and sorted by it, so that files written from it keep it."""
    order = mix(docs, **options).select(F.col("doc_id").alias("id"), F.col("tie").alias("hash"), "place").dropDuplicates(["id", "hash"])
    rows = docs.select(whole(docs), F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie"))
    both = rows.join(order, F.col("key").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("hash")))
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.repartitionByRange(parts, "place").sortWithinPartitions("place", "key").select(*unpacked(docs))


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "block", "nth", "slot", "place")
