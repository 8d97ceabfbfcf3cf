"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

A store of runs holds, for each line key, the number of documents seen with it. Batches of documents come one after
the other. A batch's keys are merge-anti-joined with the settled run, whose keys have reached the limit already and
need no more counting; the rest become a new sorted run of level 0. When a level has ``fanout`` runs, they are merged
into one of the next level, and the keys that reach the limit move to the settled run. A last compaction over all
levels settles every key. Document text never enters the store; a run has 24 bytes a key.

Defined results: a null text is one empty line; an empty key is never dropped; a document is a doc_id, so repeated
rows count once and each gets its own result; rows with a null doc_id count as one document. A line found in exactly
min_docs documents is dropped. Texts of any length are split whole, with work linear in their lines. Extra columns are
kept whatever their names, but for n_lines and n_dropped, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, bound, new_path, skew_join, unpacked, whole, written

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line stripped of blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> list[Column]:
    """128 bits: two XXH64 values with seeds that differ, so that keys stay apart at any corpus size."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """The levelled store. Every run is a table sorted by key in the shared folder."""

    def __init__(self, spark, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []

    def _write(self, df: DataFrame, name: str) -> str:
        path = new_path(self.spark, f"lines-{name}")
        df.sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths)

    def add(self, counts: DataFrame) -> None:
        """A batch: (h1, h2, n) with n documents a key, none of them in an earlier batch."""
        if self.settled:
            counts = written(counts, "batch-counts")  # else the join moves below the count, to rows that one key can crowd
            counts = counts.join(self._read(self.settled).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(counts, "0"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int, last: bool = False) -> None:
        runs, self.levels[level] = self.levels[level], []
        merged = written(self._read(runs).groupBy(*KEY).agg(F.sum("n").alias("n")), f"merge{level}")
        self.settled.append(self._write(merged.where(F.col("n") >= self.min_docs), "settled"))
        if not last:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged.where(F.col("n") < self.min_docs), str(level + 1)))

    def repeated(self) -> DataFrame:
        """(h1, h2) of the keys found in at least min_docs documents."""
        left = [p for runs in self.levels for p in runs]
        if left:
            self.levels = [left]
            self._compact(0, last=True)
        return self._read(self.settled).select(*KEY)


def without(lines: Column, drop: Column) -> Column:
    """An array without the places in drop (sorted): the runs between them, so that the work is linear in both."""
    ends = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    runs = F.transform(F.sequence(F.lit(1), F.size(drop) + 1), lambda k: F.slice(lines, F.element_at(ends, k) + 2, F.element_at(ends, k + 1) - F.element_at(ends, k) - 1))
    return F.flatten(runs)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 5, fanout: int = 4) -> DataFrame:
    """docs without the lines whose key is in at least min_docs documents; n_lines and n_dropped are added, or replaced where docs have them."""
    spark = docs.sparkSession
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    row_key = [F.col("doc_id"), F.xxhash64("text").alias("tx")]
    keys = docs.select(*row_key, F.posexplode(F.transform(lines, line_key)).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    keys = keys.select("doc_id", "tx", "pos", *key_hash(F.col("key")), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    keys = written(keys, "line-keys", by="batch")
    runs = LineRuns(spark, min_docs, fanout)
    for k in range(batches):
        batch = keys.where(F.col("batch") == k).select(*KEY, "doc_id").distinct()
        runs.add(batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
    hits = skew_join(keys.select("doc_id", "tx", "pos", *KEY), runs.repeated(), KEY, "inner")
    drops = hits.groupBy("doc_id", "tx").agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    rows = docs.select(whole(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    out = rows.join(drops, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tx")), "left")
    text = F.coalesce("whole.text", F.lit(""))
    lines = F.split(text, "\n")
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(bound(lines, lambda x: without(x, F.col("drop"))), "\n"))
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long")
    return out.select(*unpacked(docs, text=kept, n_lines=F.size(lines).cast("long"), n_dropped=n_dropped))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(r.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY doc_id
"""
