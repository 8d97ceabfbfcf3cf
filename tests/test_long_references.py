"""References in tiles against whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarp.config import options
from tracewarp.operators import expected, long_references, mapping
from tracewarp.sources import files


def fasta(path, records, width, end="\n"):
    path.write_bytes("".join(f">{n}{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for n, s in records).encode())


@pytest.mark.parametrize(("size", "overlap", "block"), [(50, 0, 3), (64, 5, 4096), (7, 20, 2), (10_000, 3, 5)])
def test_fasta_tiles(spark, tmp_path, size, overlap, block):
    rng = np.random.default_rng(size)
    one = [(f"r{i} more words", "".join(rng.choice(list("ACGTU"), n))) for i, n in enumerate((300, 0, 1, 64, 50, 1000))]
    (tmp_path / "f").mkdir()
    fasta(tmp_path / "f/a.fa", one, 13)
    fasta(tmp_path / "f/b.fa", [("r0\tx", "ACGT" * 40), ("", "GG")], 70, "\r\n")
    (tmp_path / "f/c.fa").write_text("ACGT\nACGT\n>only\nAC GT\n\n  \nTT\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        got = files.read_fasta_tiles(spark, str(tmp_path / "f"), size, overlap, block).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    records = [("a.fa", n.split()[0], s) for n, s in one] + [("b.fa", "r0", "ACGT" * 40), ("b.fa", "", "GG"), ("c.fa", "only", "ACGTTT")]
    want = {(f, n, at, s.replace("U", "T")[at : at + size + overlap]) for f, n, s in records for at in range(0, len(s), size)}
    assert {(r["file"].rsplit("/", 1)[1], r["name"], r["at"], r["seq"]) for r in got} == want and len(got) == len(want)


def model(spark, k):
    return spark.range(4**k).select(F.col("id").alias("code"), (60.0 + F.col("id") * 37 % 101 * 0.6).alias("level_mean"))


@pytest.mark.parametrize(("w", "least"), [(0, 0.3), (4, 0.9), (3, None)])
def test_index_of_tiles_equals_that_of_whole_references(spark, tmp_path, w, least):
    rng, k = np.random.default_rng(3), 3
    flat = "A" * 500 + "CCCCCG" * 30  # several tiles in which nothing is kept, and folds that differ by their start
    records = [("x", "".join(rng.choice(list("ACGT"), 1500)) + flat + "".join(rng.choice(list("ACGT"), 200))), ("y", "".join(rng.choice(list("ACGT"), 64))), ("z", "AC")]
    fasta(tmp_path / "a.fa", records, 60)
    whole = spark.createDataFrame(records, "ref_id string, seq string")
    o = options("viral", w=w, least_change=least)
    want = mapping.build_index(expected.expected_signals(whole, model(spark, k), k), o.e, o.w, o.least_change)
    tiles = files.read_fasta_tiles(spark, str(tmp_path / "a.fa"), 64, k - 1, 8).select(F.col("name").alias("ref_id"), "at", "seq")
    signals = long_references.tiled_signals(tiles, model(spark, k), k, str(tmp_path / "work"))
    assert signals.agg(F.max(F.size("signal"))).first()[0] <= 64
    got = long_references.index_of_tiles(signals, o, str(tmp_path / "work"), 50)
    key = lambda df: sorted((r["ref_id"], r["strand"], r["t"], r["hash"]) for r in df.collect())
    assert len(key(want)) > 200 and key(got) == key(want)


def test_tiles_agree_however_they_start(spark, tmp_path):
    """A staircase of steps just under the least change: what is kept depends on the first event, tile after tile."""
    steps = [0.2 * i for i in range(240)]
    rows = [(0, 0, at, steps[at : at + 16]) for at in range(0, 240, 16)]
    df = spark.createDataFrame(rows, "ref_id long, strand int, start long, signal array<double>")
    got = long_references.kept_in_tiles(df, 0.5, str(tmp_path / "work")).collect()
    kept = [0]
    for i, x in enumerate(steps):
        if abs(x - steps[kept[-1]]) >= 0.5:
            kept.append(i)
    assert sorted(x["pos"] for r in got for x in r["kept"]) == kept


def test_reads_map_to_references_in_tiles(spark, tmp_path):
    rng, k = np.random.default_rng(9), 4
    records = [(i, "".join(rng.choice(list("ACGT"), 3000))) for i in range(2)]
    whole = spark.createDataFrame(records, "ref_id long, seq string")
    refs = expected.expected_signals(whole, model(spark, k), k)
    reads = refs.where("strand = 1").select(F.col("ref_id").alias("read_id"), F.slice("signal", 1000, 120).alias("signal"))
    o = options("viral")
    tiles = whole.select("ref_id", F.explode(F.sequence(F.lit(0), F.char_length("seq") - 1, F.lit(500))).alias("at"), "seq").select("ref_id", "at", F.substring("seq", F.col("at") + 1, F.lit(500 + k - 1)).alias("seq"))
    signals = long_references.tiled_signals(tiles, model(spark, k), k, str(tmp_path / "work"))
    index = long_references.index_of_tiles(signals, o, str(tmp_path / "work"), 300)
    hits = mapping.anchors(reads, index, o.e, o.w, o.least_change)
    got = {r["read_id"]: r for r in mapping.best_places(hits, reads, signals, o).collect()}
    want = {r["read_id"]: r for r in mapping.map_reads(reads, refs, o).collect()}
    assert {i: (r["ref_id"], r["strand"], r["t_start"], r["n_anchors"], r["mapq"]) for i, r in got.items()} == {i: (r["ref_id"], r["strand"], r["t_start"], r["n_anchors"], r["mapq"]) for i, r in want.items()}
    assert all(r["ref_id"] == i and r["strand"] == 1 for i, r in got.items()) and len(got) == 2
