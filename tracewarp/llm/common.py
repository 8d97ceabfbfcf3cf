"""What several operators share: written tables, skew-proof look-ups, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D. bytes.split() and bytes.strip() use the same six bytes.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_lock = threading.Lock()
#: The scopes around the code that runs, outermost first: each scratch() adds one. A thread starts without any.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one."""
    with _lock:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tracewarp.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tracewarp-")
            spark.conf.set("spark.tracewarp.dir", base)
    return base.rstrip("/")


def _session(spark: SparkSession) -> str:
    """A name for this session's tables, kept in its own settings."""
    with _lock:
        if not (name := spark.conf.get("spark.tracewarp.scope", None)):
            name = uuid.uuid4().hex[:12]
            spark.conf.set("spark.tracewarp.scope", name)
    return name


def _scope(spark: SparkSession) -> tuple[str, ...]:
    return (_session(spark), *_scopes.get())


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder of the scope that runs, so that removing a scope removes it."""
    return "/".join([shared_dir(spark), "tracewarp", *_scope(spark), f"{name}-{uuid.uuid4().hex[:12]}"])


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _remove_scope(spark: SparkSession, scope: tuple[str, ...]) -> None:
    for row in spark.sql(f"SHOW TABLES LIKE 'tracewarp_{'_'.join(scope)}_*'").collect():
        spark.sql(f"DROP TABLE IF EXISTS {row['tableName']}")
    remove(spark, "/".join([shared_dir(spark), "tracewarp", *scope]))


@contextmanager
def scratch(spark: SparkSession):
    """Removes the intermediate tables written inside, when left. Results that outlive it must be written before with keep()."""
    token = _scopes.set((*_scopes.get(), uuid.uuid4().hex[:12]))
    try:
        yield
    finally:
        scope = _scope(spark)
        _scopes.reset(token)
        _remove_scope(spark, scope)


def keep(df: DataFrame, name: str) -> DataFrame:
    """written(), for the code outside of the innermost scratch()."""
    token = _scopes.set(_scopes.get()[:-1])
    try:
        return written(df, name)
    finally:
        _scopes.reset(token)


def release(spark: SparkSession) -> None:
    """Removes all that operators have written for this session's lazy results, in whatever thread. These can't be read afterwards."""
    _remove_scope(spark, (_session(spark),))


def written(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation. ``by`` parts its files."""
    return saved(df, new_path(df.sparkSession, name), compression, by)


def saved(df: DataFrame, path: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    out = df.write.option("compression", compression)
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, compression: str = "zstd") -> DataFrame:
    """Like written(), with rows in buckets of key, so that grouping by key later needs no shuffle of these rows."""
    spark = df.sparkSession
    table, path = f"tracewarp_{'_'.join(_scope(spark))}_{uuid.uuid4().hex[:12]}", new_path(spark, name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.write.option("path", path).option("compression", compression)
    out.bucketBy(parts, key).saveAsTable(table)
    return spark.table(table)


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no helper column meets a caller's name."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")


def unpacked(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of a whole(), with those named replaced or added."""
    same = [new.pop(c).alias(c) if c in new else F.col(f"whole.`{c}`").alias(c) for c in docs.columns]
    return [*same, *(v.alias(k) for k, v in new.items())]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else kept. Spark's lower() is right, and quicker, where every character is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def bound(array: Column, body) -> Column:
    """body(array) with the array computed once: it becomes a lambda's variable."""
    return F.get(F.transform(F.array(array), body), F.lit(0))


def skew_join(big: DataFrame, unique: DataFrame, keys: list[str], how: str = "left", most: int = 1000, least: int = 64) -> DataFrame:
    """big joined with a table of one row per key, however skewed big's keys are.

    Keys with over 1/most of big's rows (and over ``least`` rows) are at most ``most`` in number, so their rows of
    ``unique`` are broadcast and their rows of big stay where they are. The others meet by a shuffle. big should be
    a written table, as it is read twice. Null keys match nothing.
    """
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = big.count()
    hot = counts.where(F.col("_n") > max(least, total // most)).select(*keys).na.drop().limit(most).collect()
    if not hot:
        return big.join(unique, keys, how)
    hot_keys = F.broadcast(big.sparkSession.createDataFrame(hot, big.select(*keys).schema))
    hot_side = F.broadcast(unique.join(hot_keys, keys, "left_semi"))
    few = big.join(hot_keys, keys, "left_semi").join(hot_side, keys, how)
    many = big.join(hot_keys, keys, "left_anti").join(unique.join(hot_keys, keys, "left_anti"), keys, how)
    return few.unionByName(many)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component_id): for each node with an edge, the smallest node that it reaches.

    Alternates the large-star and the small-star step, which keep each component connected and end with every node
    linked to its smallest one after O(log n) rounds in practice. Each round is a written table, so no lineage grows.
    Loops and repeated edges are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    place = new_path(spark, f"{name}-0")
    e = saved(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), place)
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last, n = sign(e), 0
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        half, old, place = new_path(spark, f"{name}-l{n}"), place, new_path(spark, f"{name}-s{n}")
        large = saved(large, half)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), place)
        now, n = sign(e), n + 1
        for path in (old, half):
            remove(spark, path)
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
