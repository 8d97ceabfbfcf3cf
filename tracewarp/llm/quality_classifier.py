"""Quality classifier: interpolated modified Kneser-Ney n-grams of bytes, trained on trusted text.

Trusted text is that of all documents labelled good and, where labels say so, not toxic. One in ``held_out`` of them, by a hash of doc_id, stays
out of training: means and thresholds come from these, and counts from all others. Only a caller that gives ``max_trusted`` bounds the fit, to
the labelled rows with the smallest hashes; all trusted rows beyond them then count for means and thresholds. An n-gram is the integer of its bytes, so keys are exact. Counts are tables partitioned by key: the
highest order has occurrence counts; each lower order has continuation counts, grouped from the distinct n-grams above.

Documents are cut into chunks of whole texts. A chunk asks once for each of its distinct n-grams, which are few beside
its bytes. The distinct requests of all chunks go through the orders from the lowest up: requests join the counts, the
contexts and the next lower order by key, and give interpolated probabilities. These go back to the chunks that asked,
and a co-grouped task adds up the documents' bits. Texts are written once, compressed and in buckets of chunks, and never
shuffled: which of them are trusted goes to their chunks as ids, and a co-grouped task counts the n-grams of those to train on.

Perplexities are per byte, and those of short texts are drawn towards their language's mean over trusted text as if
``prior`` bytes of it stood before them. A document is kept if this smoothed perplexity is at most its language's
quantile among the trusted documents, times ``slack``. With fewer than ``least`` of these, that quantile is little more
than their maximum: the threshold is then the language's geometric mean times the spread (quantile over mean) of the
languages that have enough, or the normal quantile of its own lower quartile's distance, which junk hardly moves, if
wider. It is widened for the mean's own error, and holds where it is more. A language without trusted documents stands
about the median of its own documents, with the same spread.

Defined results: a null or empty text has no perplexity and isn't kept; a null language is one of its own; repeated rows
are scored each; without trusted rows every text has perplexity 256 and is kept. Among rows for a bounded fit the hash and
then the smaller doc_id decide; a perplexity equal to the threshold is kept; texts of any length are scored whole; an empty
table gives an empty result. Extra columns are kept whatever their names.
"""

from __future__ import annotations

import math
from itertools import islice
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, written

ORDER = 5
#: What a document is to the model: one of its training texts, or a trusted text that it hasn't seen and thresholds come from.
TRAIN, HELD = 1, 2


def grams(raw: bytes, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as an integer; zero bytes stand before the text."""
    b = np.frombuffer(bytes(order - 1) + raw, np.uint8).astype(np.int64)
    key = np.zeros(len(raw), np.int64)
    for i in range(order):
        key = (key << 8) | b[i : len(raw) + i]
    return key


def _chunks(docs: DataFrame, chunk_bytes: int, order: int) -> DataFrame:
    """Rows of documents (doc_id, tx, lang, z) and rows of requests (key) by chunk, as a table in buckets of chunk."""
    schema = "chunk long, doc_id long, tx long, lang string, z binary, key long"
    names = ["chunk", "doc_id", "tx", "lang", "z", "key"]

    def flush(chunk, rows, raws):
        pack, asked = zstandard.ZstdCompressor(level=6), []
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512]
            asked.append(np.unique(np.concatenate([grams(r, order) for r in raws[i : i + 512]])))
            z = [pack.compress(r) for r in raws[i : i + 512]]
            cols = [pa.array([chunk] * len(part), pa.int64()), *(pa.array([r[c] for r in part], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string()))), pa.array(z, pa.binary()), pa.nulls(len(part), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)
        keys = np.unique(np.concatenate(asked))
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.array(keys)], names)

    def run(batches):
        task, made, size, rows, raws = TaskContext.get().partitionId(), 0, 0, [], []
        for b in batches:
            for *row, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rows.append(row)
                raws.append(raw)
                size += len(raw)
                if size >= chunk_bytes:
                    yield from flush((task << 32) + made, rows, raws)
                    made, size, rows, raws = made + 1, 0, [], []
        if rows:
            yield from flush((task << 32) + made, rows, raws)

    return bucketed(docs.select("doc_id", F.xxhash64("text"), "lang", "text").mapInArrow(run, schema), "quality-chunks", "chunk")


COUNTS = pa.schema([("key", pa.int64()), ("c", pa.int64())])


def _counted(raws, order: int):
    """Batches of the distinct n-grams of texts and their numbers, each of 512 texts."""
    raws = iter(raws)
    while some := list(islice(raws, 512)):
        keys, n = np.unique(np.concatenate([grams(r, order) for r in some]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], schema=COUNTS)


def _trained(texts: DataFrame, members: DataFrame, order: int) -> DataFrame:
    """(key, c): n-grams of the texts (chunk, doc_id, z) that members (home, member) name in their chunk, by chunk. Only members are shuffled."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        mine = left["z"].filter(pc.is_in(left["doc_id"], value_set=right["member"].combine_chunks()))
        return pa.Table.from_batches(_counted((unpack.decompress(z.as_py()) for z in mine), order), COUNTS)

    return texts.groupBy("chunk").cogroup(members.groupBy("home")).applyInArrow(run, "key long, c long")


def _counts(trusted: DataFrame, order: int) -> list[DataFrame]:
    """Tables (key, c) of orders 1 to order: continuation counts, and occurrences for the highest order, of trusted (text), or of its n-grams
    where these are counted in parts (key, c)."""

    def run(batches):
        for b in batches:
            yield from _counted(((t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(0)), order)

    parts = trusted if "key" in trusted.columns else trusted.select("text").mapInArrow(run, "key long, c long")
    top = parts.groupBy("key").agg(F.sum("c").alias("c"))
    tables = [written(top, f"quality-{order}")]
    for k in range(order - 1, 0, -1):
        shorter = tables[0].select(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")).alias("key"))
        tables.insert(0, written(shorter.groupBy("key").agg(F.count(F.lit(1)).alias("c")), f"quality-{k}"))
    return tables


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts; a half of the count where those are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05 * i), 0.95 * i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def probabilities(requests: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(key, p) of the distinct keys of requests: interpolated modified Kneser-Ney, by joins from the lowest order up."""
    order = len(tables)
    asked = [requests.select("key").distinct()]
    for k in range(order - 1, 0, -1):
        asked.insert(0, asked[0].select(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")).alias("key")).distinct())
    lower = None
    for k, (want, table) in enumerate(zip(asked, tables, strict=True), 1):
        n = table.agg(*(F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4))).first()
        d1, d2, d3 = discounts(*n)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = table.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"))
        rows = want.withColumn("context", F.shiftright("key", 8)).withColumn("short", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1).cast("long")))
        rows = rows.join(table.select("key", "c", cut.alias("cut")), "key", "left").join(context, "context", "left")
        if lower is None:
            rows = rows.withColumn("low", F.lit(1 / 256))
        else:
            rows = rows.join(lower.select(F.col("key").alias("short"), F.col("p").alias("low")), "short", "left")
        p = F.when(F.col("total").isNull(), F.col("low")).otherwise((F.coalesce(F.col("c") - F.col("cut"), F.lit(0.0)) + F.col("freed") * F.col("low")) / F.col("total"))
        lower = written(rows.select("key", p.alias("p")), f"quality-p{k}")
    return lower


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct doc_ids (_good) labelled good and, if labels have that column, not toxic."""
    clean = "quality = 1 and toxic = 0" if "toxic" in labels.columns else "quality = 1"
    return labels.where(clean).select(F.col("doc_id").cast("long").alias("_good")).where("_good is not null").distinct()


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER, max_trusted: int | None = None, held_out: int = 5, chunk_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, tx (the text's hash), lang, role, bits and n (bytes) of every row of docs, as a written table."""
    every = trusted_ids(labels)
    role = F.when(F.crc32(F.col("_good").cast("string")) % held_out == 0, HELD).otherwise(TRAIN)
    if max_trusted is None:
        roles = every.select("_good", role.alias("role"))
    else:
        good = every.orderBy(F.xxhash64("_good"), "_good").limit(max_trusted).select("_good", role.alias("role"))
        roles = every.join(F.broadcast(good), "_good", "left").select("_good", F.coalesce("role", F.lit(HELD)).alias("role"))
    roles = written(roles, "quality-trusted")
    chunks = _chunks(docs.select(F.col("doc_id").cast("long"), "lang", "text"), chunk_bytes, order)
    texts = chunks.where("z is not null")
    members = texts.select(F.col("chunk").alias("home"), F.col("doc_id").alias("member")).join(roles.where(F.col("role") == TRAIN), F.col("member") == F.col("_good")).select("home", "member")
    tables = _counts(_trained(texts.select("chunk", "doc_id", "z"), members, order), order)
    requests = chunks.where("key is not null").select("chunk", "key")
    answers = requests.join(probabilities(requests, tables), "key").select(F.col("chunk").alias("asker"), "key", F.log2("p").cast("float").alias("bits"))
    rows = texts.select("chunk", "doc_id", "tx", "lang", "z")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, bits = right["key"].to_numpy(), right["bits"].to_numpy().astype(float)
        by = np.argsort(keys)
        keys, bits = keys[by], bits[by]
        unpack, found, size = zstandard.ZstdDecompressor(), [], []
        for z in left["z"]:
            raw = unpack.decompress(z.as_py())
            found.append(-float(bits[np.searchsorted(keys, grams(raw, order))].sum()) if raw else 0.0)
            size.append(len(raw))
        scored = left.select(["doc_id", "tx", "lang"]).append_column("bits", pa.array(found, pa.float64()))
        return scored.append_column("n", pa.array(size, pa.int64()))

    schema = "doc_id long, tx long, lang string, bits double, n long"
    scored = written(rows.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(score, schema), "quality-scores")
    of = lambda role: ("doc_id", "tx", "lang", role.alias("role"), "bits", "n")
    named = scored.where("doc_id is not null").join(roles, F.col("doc_id") == F.col("_good"), "left").select(*of(F.coalesce("role", F.lit(0))))
    return written(named.unionByName(scored.where("doc_id is null").select(*of(F.lit(0)))), "quality-roles")


def _limit(lang, spread: float, least: int, deviations: float) -> float:
    """The logarithm of a language's threshold, without slack."""
    if lang["k"] >= least:
        return lang["limit"]
    quarter, median = lang["quarters"]
    spread = max(0.0, spread, deviations * (median - quarter) / NormalDist().inv_cdf(0.75))
    if lang["k"]:
        return max(lang["limit"], lang["center"] + spread * math.sqrt(1 + 1 / lang["k"]))
    return median + spread


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05, prior: int = 64, least: int = 1000, **options) -> DataFrame:
    """doc_id, tx, lang, perplexity, smoothed, threshold and kept of every row of docs (doc_id, text, lang)."""
    scored = perplexities(docs, labels, **options)
    spark = scored.sparkSession
    held = F.col("role") == HELD
    some = scored.where("n > 0")
    means = some.groupBy("lang").agg((F.sum(F.when(held, F.col("bits"))) / F.sum(F.when(held, F.col("n")))).alias("mean"), F.percentile_approx(F.col("bits") / F.col("n"), 0.5, 100_000).alias("median")).collect()  # a row a language
    table = F.broadcast(spark.createDataFrame([(r["lang"], r["median"] if r["mean"] is None else r["mean"]) for r in means], "_lang string, mean double"))
    scored = scored.join(table, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    mean = F.coalesce("mean", F.lit(8.0))
    scored = scored.select("doc_id", "tx", "lang", "role", F.when(F.col("n") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n"))).alias("perplexity"), F.when(F.col("n") > 0, F.pow(F.lit(2.0), (F.col("bits") + prior * mean) / (F.col("n") + prior))).alias("smoothed"))
    level = F.when(held, F.ln("smoothed"))
    by_lang = scored.where("smoothed is not null").groupBy("lang").agg(F.count(level).alias("k"), F.avg(level).alias("center"), F.percentile_approx(level, quantile, 100_000).alias("limit"), F.percentile_approx(F.ln("smoothed"), [0.25, 0.5], 100_000).alias("quarters")).collect()  # a row a language
    rich = [r for r in by_lang if r["k"] >= least] or [r for r in by_lang if r["k"]]
    centers = F.broadcast(spark.createDataFrame([(r["lang"], r["center"]) for r in rich], "_lang string, center double"))
    around = scored.where(held & F.col("smoothed").isNotNull()).join(centers, F.col("lang").eqNullSafe(F.col("_lang")))
    spread = around.agg(F.percentile_approx(F.ln("smoothed") - F.col("center"), quantile, 100_000)).first()[0]
    limits = [(r["lang"], math.exp(_limit(r, spread, least, NormalDist().inv_cdf(quantile))) * slack) for r in by_lang] if rich else []
    limits = F.broadcast(spark.createDataFrame(limits, "_lang string, threshold double"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))
    return out.select("doc_id", "tx", "lang", "perplexity", "smoothed", "threshold", F.coalesce(F.col("smoothed") <= F.col("threshold"), F.lit(False)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that classify() keeps."""
    kept = classify(docs, labels, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("tx").alias("_h")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_h"]), "left_semi")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")).drop("tx")
