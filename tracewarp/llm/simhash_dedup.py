"""SimHash near-dedup: segment popcounts as an embedding, a grid range-join, exact verification.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the vector of their popcounts moves by at most one step in
the Manhattan distance for each differing bit, so that distance bounds the Hamming distance from below. Vectors within
distance 2 have a grid point within distance 1 of both, and it lies between them. So each distinct fingerprint goes to
its own grid point and the neighbouring ones (33 at most), fingerprints that share a point are candidates, and the
exact test is one xor and a bit count.

Groups of near copies fill some points. A point with over ``crowd`` fingerprints makes no pairs: its members go to
their own value and the 64 values that differ in one bit instead. Two fingerprints are within 2 bits if and only if
they share such a value, so linking each to the smallest one there keeps every component, with 65 rows a fingerprint.
Equal fingerprints are one vertex from the start.

Defined results: a null or empty text has fingerprint zero, linked like any other; rows with a null doc_id get a
fingerprint and no component of their own making (they take their fingerprint's); repeated rows are kept; a bit set in
exactly half of the hashes is 0; texts of any length are taken whole; an empty table gives an empty result. Columns other
than doc_id and text aren't read by simhash_dedup().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, skew_join, written

BITS, SEGMENTS, WIDTH = 2, 16, 4


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return bits_of(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64))


def bits_of(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of docs."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _popcounts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))) for i in range(SEGMENTS)]


def popcount_distance(a: Column, b: Column) -> Column:
    """The Manhattan distance of two fingerprints' segment popcounts, at most the number of bits in which they differ."""
    total = F.lit(0)
    for x, y in zip(_popcounts(a), _popcounts(b), strict=True):
        total = total + F.abs(x - y)
    return total


def _points(fp: Column) -> Column:
    """The grid points of a fingerprint: its popcount vector, three bits a segment, and the neighbours one step away."""
    counts = _popcounts(fp)
    own = F.lit(0).cast("long")
    for i, c in enumerate(counts):
        own = own + c.cast("long") * F.lit(1 << (3 * i)).cast("long")
    near = [F.when(c > 0, own - F.lit(1 << (3 * i)).cast("long")) for i, c in enumerate(counts)]
    near += [F.when(c < WIDTH, own + F.lit(1 << (3 * i)).cast("long")) for i, c in enumerate(counts)]
    return F.array_compact(F.array(own, *near))


def _hubs(fp: Column) -> Column:
    return F.array(fp, *(fp.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)))


def near_links(reps: DataFrame, crowd: int = 48) -> DataFrame:
    """(a, b) of ids: links within 2 bits between rows (fp, rep) of distinct fingerprints, enough to connect every component."""
    members = written(reps.select("fp", "rep", F.explode(_points(F.col("fp"))).alias("cell")), "simhash-cells")
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    thin = written(members.join(sizes, "cell"), "simhash-shared")
    a = thin.where(F.col("size") <= crowd).select("cell", F.col("fp").alias("fa"), F.col("rep").alias("a"))
    b = a.select("cell", F.col("fa").alias("fb"), F.col("a").alias("b"))
    close = (a["fa"] < b["fb"]) & (F.bit_count(a["fa"].bitwiseXOR(b["fb"])) <= BITS)
    pairs = a.join(b, (a["cell"] == b["cell"]) & close).select("a", "b")
    full = thin.where(F.col("size") > crowd).select("fp", "rep").distinct()
    hubs = full.select("fp", "rep", F.explode(_hubs(F.col("fp"))).alias("hub"))
    heart = hubs.groupBy("hub").agg(F.min(F.struct("rep", "fp")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = hubs.join(heart, "hub").where((F.col("rep") != F.col("h.rep")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("h.fp"))) <= BITS))
    return pairs.unionByName(star.select(F.col("rep").alias("a"), F.col("h.rep").alias("b"))).distinct()


def simhash_dedup(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text)."""
    marked = written(fingerprints(docs, words, seed), "simhash-fp")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).repartition(parts, "fp"), "simhash-reps")
    found = components(near_links(reps.where("rep is not null")), name="simhash")
    classes = reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return skew_join(marked, written(classes, "simhash-classes"), ["fp"], "left")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The row with the smallest doc_id of each group of texts whose five-word shingles have similarity 0.8; see minhash_dedup."""
    from .minhash_dedup import one_of_each

    return one_of_each(docs, **options)


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash_dedup(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
