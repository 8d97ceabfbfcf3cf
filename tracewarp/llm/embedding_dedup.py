"""Embedding near-dedup: sorted projection passes.

Each pass orders the distinct vectors lexicographically by the signs of its own random hyperplanes, so near vectors
tend to stand together. The order is cut into windows of ``window`` rows that overlap by half; rows of a window are
compared with each other, and the links found are united across passes. A row's rank in the order comes from its place
in its range partition and the partitions' sizes. The first passes are as many as evenly spread vectors need. A dense group
of vectors that aren't links of each other needs more, as a bit parts few of them: the numbers of links of ``probe`` vectors
are held against those that a scan of all vectors gives, and passes are added until ``recall`` of them are found. Where so
many would be needed that all pairs cost no more, all pairs are compared, tile by tile.

Groups of near copies make no pairs. A vector with over ``few`` links in a window is crowded: it gives one link to the
smallest vector that it reaches there. Components with a crowded vector are dealt into tiles, every two tiles are compared,
and each gives counts of links, not links: rows in proportion to vectors times tiles of ``tile`` vectors.

Equal vectors are one row with a count, however many there are, and link with each other directly.

Defined results: vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing
and are a component of their own; vectors of different lengths link with nothing of another length; repeated vec_ids
are rows of their own and take their class's smallest; a cosine equal to the threshold is a link; an empty table gives an
empty result. Columns other than vec_id and embedding aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, skew_join, written


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold has met with probability recall: it must agree on the bits that part windows."""
    bits = max(1.0, math.log2(max(2.0, 2 * n / window)))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def _array(vec: pa.Array, at=None) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    vec = vec if at is None else vec.take(pa.array(at))
    return vec.flatten().to_numpy().astype(float).reshape(len(vec), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(reps: DataFrame, passes: int, seed: int) -> DataFrame:
    """A row for each pass and vector: the signs of 64 random projections as two sortable integers."""

    def run(batches):
        planes: dict[tuple, np.ndarray] = {}
        for b in batches:
            rep, vec = b.column("rep"), b.column("vec")
            sizes = np.diff(vec.offsets.to_numpy())
            for p in range(passes):
                codes = np.empty(len(sizes), np.uint64)
                for size in np.unique(sizes):
                    if (p, size) not in planes:
                        planes[p, size] = np.random.default_rng([seed, p, size]).standard_normal((size, 64))
                    at = np.flatnonzero(sizes == size)
                    bits = np.packbits(_array(vec, at) @ planes[p, size] > 0, axis=1, bitorder="big")
                    codes[at] = bits.copy().view(">u8")[:, 0]
                code = (codes ^ np.uint64(1 << 63)).view(np.int64)
                cols = [pa.array(np.full(len(sizes), p, np.int32)), pa.array(sizes, pa.int32()), pa.array(code), rep, b.column("copies"), vec]
                yield pa.RecordBatch.from_arrays(cols, ["pass", "size", "code", "rep", "copies", "vec"])

    return reps.mapInArrow(run, f"pass int, size int, code long, rep long, copies long, vec {reps.schema['vec'].dataType.simpleString()}")


def _windows(keys: DataFrame, window: int) -> DataFrame:
    """keys with the numbers of the two overlapping windows that hold each row."""
    columns = ["pass", "size", "rep", "vec"]

    def place(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            nth = pa.array(np.arange(n, n + b.num_rows))
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), nth, *(b.column(c) for c in columns)], ["part", "nth", *columns])

    kind = keys.schema["vec"].dataType.simpleString()
    parts = max(8, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.repartitionByRange(parts, "pass", "size", "code", "rep").sortWithinPartitions("pass", "size", "code", "rep")
    placed = written(ordered.mapInArrow(place, f"part int, nth long, pass int, size int, rep long, vec {kind}"), "vector-order")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    rank = F.col("before") + F.col("nth")
    half = window // 2
    numbers = F.array(F.floor(rank / half), F.floor(rank / half) + 1)
    return placed.join(F.broadcast(before), "part").select(F.explode(numbers).alias("window"), "pass", "size", "rep", "vec")


def _roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation, the smallest row that it reaches."""
    low = np.arange(len(near))
    while True:
        new = np.minimum(low, np.where(near, low[None, :], len(near)).min(1, initial=len(near)))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _met(reps: DataFrame, passes: int, threshold: float, window: int, seed: int, few: int) -> DataFrame:
    """(a, b, crowded): the links that meet in a window of some pass; those of a crowded vector as one link to its group's smallest."""

    def compare(table: pa.Table) -> pa.Table:
        p, size, rep = (table[c].to_numpy() for c in ("pass", "size", "rep"))
        a, b, crowd = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for key in np.unique(np.stack([p, size], 1), axis=0):
            at = np.flatnonzero((p == key[0]) & (size == key[1]))
            at = at[np.argsort(rep[at])]
            x, ids = _unit(_array(table["vec"], at)), rep[at]
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            full = near.sum(1) > few
            if full.any():
                joined = near & (full[:, None] | full[None, :])
                low = _roots(joined)
                of = np.flatnonzero(low != np.arange(len(low)))
                a.append(ids[low[of]])
                b.append(ids[of])
                crowd.append(np.ones(len(of), bool))
                near &= ~joined
            i, j = np.nonzero(np.triu(near, 1))
            a.append(ids[i])
            b.append(ids[j])
            crowd.append(np.zeros(len(i), bool))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "crowded": np.concatenate(crowd)})

    windows = _windows(_keys(reps, passes, seed), window)
    return windows.groupBy("window").applyInArrow(compare, "a long, b long, crowded boolean").distinct()


def probed_counts(reps: DataFrame, threshold: float, probe: int) -> DataFrame:
    """(rep, n): the number of links (copies counted) of at most ``probe`` vectors, the smallest by a hash of their id, among all."""
    some = reps.orderBy(F.xxhash64("rep"), "rep").limit(probe).collect()
    known = {}
    for size in {len(r["vec"]) for r in some}:
        these = [r for r in some if len(r["vec"]) == size]
        known[size] = np.array([r["rep"] for r in these], np.int64), _unit(np.array([r["vec"] for r in these], float))

    def run(batches):
        found = {size: np.zeros(len(of), np.int64) for size, (of, _) in known.items()}
        for batch in batches:
            ids, copies, vec = batch.column("rep").to_numpy(), batch.column("copies").to_numpy(), batch.column("vec")
            sizes = np.diff(vec.offsets.to_numpy())
            for size in map(int, np.unique(sizes)):
                if size in known:
                    at = np.flatnonzero(sizes == size)
                    of, x = known[size]
                    for k in range(0, len(at), 1024):
                        part = at[k : k + 1024]
                        near = x @ _unit(_array(vec, part)).T >= threshold
                        found[size] += (near & (of[:, None] != ids[part][None, :])) @ copies[part]
        for size, n in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(known[size][0]), pa.array(n)], ["rep", "n"])

    return reps.mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).where("n > 0")


def tile_counts(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(rep, n, low) for rows (rep, copies, vec, component_id): links inside each component with one other tile, and the smallest vector reached there."""
    tiles = members.groupBy("component_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = skew_join(members, written(tiles, "vector-tiles"), ["component_id"], "inner").withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")})

    def compare(table: pa.Table) -> pa.Table:
        ids, copies, tiles = table["rep"].to_numpy(), table["copies"].to_numpy(), table["tile"].to_numpy()
        vec = table["vec"].combine_chunks()
        sizes, n, low = np.diff(vec.offsets.to_numpy()), np.zeros(len(ids), np.int64), ids.copy()
        for size in np.unique(sizes):
            here = np.flatnonzero(sizes == size)
            x, t = _unit(_array(vec, here)), tiles[here]
            left, right = np.flatnonzero(t == tiles.min()), np.flatnonzero(t == tiles.max())
            same = tiles.min() == tiles.max()
            for k in range(0, len(left), 1024):
                part = left[k : k + 1024]
                near = x[part] @ x[right].T >= threshold
                if same:
                    near[np.arange(len(part)), np.arange(k, k + len(part))] = False
                for me, you, link in ((here[part], here[right], near), (here[right], here[part], near.T)):
                    low[me] = np.minimum(low[me], np.where(link, ids[you][None, :], low[me][:, None]).min(1, initial=np.iinfo(np.int64).max))
                n[here[part]] += near @ copies[here[right]]
                if not same:
                    n[here[right]] += near.T @ copies[here[part]]
        some = np.flatnonzero(n)
        return pa.table({"rep": ids[some], "n": n[some], "low": low[some]})

    return dealt.select("component_id", "one", "two", "tile", "rep", "copies", "vec").groupBy("component_id", "one", "two").applyInArrow(compare, "rep long, n long, low long")


def near_links(reps: DataFrame, threshold: float, window: int = 1024, recall: float = 0.98, seed: int = 11, probe: int = 4096, few: int = 64, tile: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(rep, n), the number of links of each vector that has any, and (node, component_id) of these, among rows (rep, copies, vec) of distinct vectors."""
    reps = written(reps.select("rep", "copies", "vec"), "vector-reps")
    n = reps.count()
    passes = passes_for(n, threshold, window, recall)
    truth = written(probed_counts(reps, threshold, probe), "vector-probed")
    links, added = None, passes
    while True:
        met = _met(reps, added, threshold, window, seed, few)
        links = written(met if links is None else links.unionByName(met).distinct(), "vector-met")
        found = written(components(links, name="vectors"), "vector-components")
        counts = written(_degrees(reps, links, found, threshold, tile), "vector-counts")
        share = truth.join(counts.withColumnRenamed("n", "got"), "rep", "left").select("n", F.coalesce("got", F.lit(0)).alias("got"))
        r = share.agg((F.sum("got") / F.sum("n")).alias("links"), F.avg(F.col("got") / F.col("n")).alias("vectors")).first()
        reached = 1.0 if r["links"] is None else min(r["links"], r["vectors"])
        if reached >= recall:
            return counts, found
        added = max(1, math.ceil(passes * (math.log(1 - recall) / math.log(1 - reached) - 1))) if reached > 0 else passes
        if passes + added > n / (2 * window):
            every = written(tile_counts(reps.withColumn("component_id", F.lit(0).cast("long")), threshold, tile), "vector-tiles")
            found = components(every.select(F.col("rep").alias("a"), F.col("low").alias("b")), name="vectors")
            return every.groupBy("rep").agg(F.sum("n").alias("n")), found
        passes, seed = passes + added, seed + 1


def _degrees(reps: DataFrame, links: DataFrame, found: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(rep, n): links as listed, or, in components with a crowded vector, as counted over all the component's pairs."""
    crowds = links.where("crowded").select(F.col("a").alias("node")).distinct().join(found, "node").select("component_id").distinct()
    crowds = written(crowds, "vector-crowds")
    placed = found.withColumnRenamed("node", "rep").join(crowds.withColumn("crowd", F.lit(True)), "component_id", "left")
    placed = written(placed, "vector-placed")
    members = written(reps.join(placed.where("crowd").select("rep", "component_id"), "rep"), "vector-members")
    dense = tile_counts(members, threshold, tile).groupBy("rep").agg(F.sum("n").alias("n"))
    thin = links.where("not crowded")
    ends = thin.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(thin.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    ends = ends.join(placed.where("crowd is null").select("rep"), "rep")
    sparse = ends.join(reps.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("n"))
    return dense.unionByName(sparse)


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, window: int = 1024, recall: float = 0.98, **options) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select("vec_id", F.when(good, F.col("embedding")).alias("raw"), F.when(good, norm).alias("norm"))
    vec = F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.col("raw"))
    rows = written(rows.select("vec_id", vec.alias("vec")).withColumn("digest", F.sha2(F.to_json(F.struct("vec")), 256)), "vectors")
    reps = rows.where("vec is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    reps = written(reps, "vector-classes")
    links, found = near_links(reps, threshold, window, recall, **options)
    classes = reps.select("digest", "rep", "copies").join(links, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = skew_join(rows.where("vec is not null").select("vec_id", "digest"), written(classes, "vector-results"), ["digest"], "inner").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id)::BIGINT AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
