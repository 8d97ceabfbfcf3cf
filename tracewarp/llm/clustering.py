"""Centroid clustering by weighted deduplication.

Vectors are quantised to whole numbers, and identical ones become one row with their multiplicity. Lloyd's rounds run over these
distinct vectors only: tasks assign a batch at a time and add up ``weight * vector`` and weights for each centroid, so a round sends
``k * dims`` sums of whole numbers a task to the driver's new centroids. The last assignment goes back to the vec_ids by a join that
leaves frequent vectors' rows where they are. A vector is known there by 128 bits of hash, so the join moves 24 bytes a row.

Everything is exact: distances are sums of squares below 2^63, in doubles while all partial sums are below 2^53, else in 64-bit
integers; means are floors of whole sums.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones are left out, and so are
those with a component of 2^19 or more in size, as their distances might not fit a long. Repeated rows count again and each gets its row; a null
vec_id hashes as the text ``seed:``. Fewer vectors than k give as many centroids as vectors, of which equal ones all stay (ties go to
the smaller number). Vectors with the same vec_id start in the order of their components. An empty table gives an empty result. Other
columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, written
from .line_dedup import key_hash

SCALE, DIMS, K, ROUNDS, SEED = 256, 64, 40, 5, "2"
#: Components beyond this size have distances that a long might not hold; up to the second, doubles hold all sums exactly.
LARGEST, EXACT = 1 << 27, 1 << 22


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, key: the components as little-endian 32-bit integers) of the vectors that can be kept."""

    def run(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            if pa.types.is_large_list(lists.type):
                lists = lists.cast(pa.list_(lists.type.value_type))
            sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
            fits = (sizes == dims) & ~np.asarray(lists.is_null())
            ids, lists = ids.filter(pa.array(fits)), lists.filter(pa.array(fits))
            x = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dims)
            good = np.isfinite(x).all(1)
            q = np.floor(np.where(good[:, None], x, 0) * scale)
            good &= (np.abs(q) < LARGEST).all(1)
            rows = np.ascontiguousarray(q[good].astype("<i4"))
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), keys], ["vec_id", "key"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, key binary")


def matrix(keys: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, smaller ones first, and the squared distance) of each row, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 * 4 * x.shape[1] < 1 << 53:
        y, c = x.astype(float), centroids.astype(float)
        far = (y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)
    else:
        far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best].astype(np.int64)


def first_centroids(rows: DataFrame, k: int, seed: str, dims: int) -> np.ndarray:
    """The k vectors whose text ``seed:vec_id`` has the smallest SHA-256: k rows."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = rows.orderBy(F.sha2(text, 256), "key").limit(k).select("key").collect()
    return np.frombuffer(b"".join(bytes(r["key"]) for r in first), "<i4").reshape(-1, dims).astype(np.int64)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over distinct (key, weight)."""
    k, dims = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, w = matrix(b.column(0), dims), np.asarray(b.column(1))
            best, _ = nearest(x, centroids)
            np.add.at(total, best, x * w[:, None])
            np.add.at(count, best, w)
        at = np.repeat(np.flatnonzero(count), dims)
        dim = np.tile(np.arange(dims), np.count_nonzero(count))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(total[at, dim]), pa.array(count[at])], ["cluster", "dim", "total", "n"])

    found = distinct.select("key", "weight").mapInArrow(sums, "cluster int, dim int, total long, n long")
    new = centroids.copy()
    for r in found.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k * dims rows at most
        new[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return new


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of each vector that is kept, and the final centroids."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, dims, scale).select("vec_id", *key_hash(F.col("key")), "key"), "vectors", "zstd")
    distinct = written(rows.groupBy("h1", "h2").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("weight")), "distinct-vectors", "zstd")
    centroids = first_centroids(rows, k, seed, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)
    out = "h1 long, h2 long, weight long, cluster int, distance long"

    def assign(batches):
        for b in batches:
            best, far = nearest(matrix(b.column(3), dims), centroids)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(best.astype(np.int32)), pa.array(far)], ["h1", "h2", "weight", "cluster", "distance"])

    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"), centroids
    found = written(distinct.select("h1", "h2", "weight", "key").mapInArrow(assign, out), "assigned-vectors")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("weight")).alias("s")).collect()}  # k rows at most
    inertia = F.get(F.lit([sums.get(c, 0) for c in range(len(centroids))]).cast("array<long>"), F.col("cluster"))
    joined = skew_join(rows.select("vec_id", "h1", "h2"), found.drop("weight"), ["h1", "h2"], "inner")
    return joined.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia")), centroids


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.withColumn("centroid_sha256", F.get(F.lit(names).cast("array<string>"), F.col("cluster")))


def oracle(k: int = K, rounds: int = ROUNDS, seed: str = SEED, dims: int = DIMS, scale: int = SCALE) -> str:
    """DuckDB SQL with a step for each round."""
    steps = [f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = {dims}),
kept AS (SELECT * FROM e WHERE len(list_filter(x, lambda v: v IS NOT NULL AND isfinite(v))) = {dims}),
v AS (SELECT vec_id, unnest(range({dims})) AS dim, unnest(list_transform(x, lambda c: floor(c * {scale})::BIGINT)) AS q FROM kept),
start AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS (SELECT c, dim, q FROM v JOIN start USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
far{r} AS MATERIALIZED (SELECT vec_id, c, sum((v.q - c{r}.q) * (v.q - c{r}.q))::BIGINT AS d FROM v JOIN c{r} USING (dim) GROUP BY vec_id, c),
near{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM far{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (SELECT c, dim, sum(q)::BIGINT AS s, count(*) AS n FROM v JOIN near{r} USING (vec_id) GROUP BY c, dim),
c{r + 1} AS MATERIALIZED (SELECT c, dim, coalesce((s - ((s % n) + n) % n) // n, q) AS q FROM c{r} LEFT JOIN mean{r} USING (c, dim))""")
    return ",".join(steps) + f""",
names AS (SELECT c, sha256(string_agg(q::VARCHAR, ',' ORDER BY dim)) AS name FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, name AS centroid_sha256
FROM near{rounds} JOIN names USING (c)"""


ORACLE = oracle()
