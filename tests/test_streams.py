import collections
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute

from tracewarp.config import options
from tracewarp.functions.sketch import minimizers, seeds
from tracewarp.operators.abundance import region_coverage, tick_distances
from tracewarp.operators import mapping
from tracewarp.operators.mapping import map_reads
from tracewarp.streaming.mapper import chunk_events, map_chunks, run_until, save_tiles

SIGNAL = "signal array<double>"


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    genome = {i: rng.normal(0, 1.2, 150).tolist() for i in range(3)}
    refs = spark.createDataFrame([(i, 0, s) for i, s in genome.items()], f"ref_id long, strand int, {SIGNAL}")
    reads = {0: genome[1][20:80], 1: genome[2][60:130], 2: rng.normal(0, 1.2, 60).tolist(), 3: genome[0][:24]}
    return refs, reads


def test_minimizers_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, n).tolist()) for i, n in enumerate((0, 2, 3, 4, 9, 40))] + [(6, [0.5] * 12), (7, None)]
    df = spark.createDataFrame(rows, f"id int, {SIGNAL}")
    for w in (1, 3, 5):
        for r in df.select(seeds(F.col("signal"), 3).alias("s"), minimizers(F.col("signal"), 3, w).alias("m")).collect():
            s = [(x["pos"] - 2, x["hash"]) for x in r["s"] or []]
            width = min(w, len(s))
            want = {s[j] for i in range(len(s) - width + 1) for j in range(i, i + width) if s[j][1] == min(h for _, h in s[i : i + width])} if s else set()
            assert {(x["pos"], x["hash"]) for x in r["m"] or []} == want


@pytest.mark.parametrize("w", [0, 3])
def test_presets_reach_the_mapper(spark, world, w):
    refs, reads = world
    frame = spark.createDataFrame(list(reads.items()), f"read_id long, {SIGNAL}")
    got = {r["read_id"]: r for r in map_reads(frame, refs, options("viral", w=w, least_aligned=5.0)).collect()}
    assert (got[0]["ref_id"], got[1]["ref_id"], got[2]["ref_id"]) == (1, 2, None)
    assert got[0]["t_start"] - got[0]["q_start"] == 20 and got[1]["confident"]
    assert map_reads(frame, refs, options("viral", w=w, least_aligned=None)).where("ref_id is not null").count() >= 2


def replay(spark, chunks, refs, refs_df, o):
    """Decisions by the rules written out: chunks is {read: [events, ...]}."""
    index = mapping.build_index(refs_df, o.e, o.w, o.least_change)
    rows = [(i, k, x) for i, parts in chunks.items() for k, x in enumerate(parts) if len(x) >= o.least_events]
    df = spark.createDataFrame([(i * 1000 + k, x) for i, k, x in rows], f"read_id long, {SIGNAL}")
    hits = collections.defaultdict(list)
    for h in mapping.anchors(df, index, o.e, o.w, o.least_change).collect():
        hits[divmod(h["read_id"], 1000)].append(h)
    out = {}
    for i, parts in chunks.items():
        kept, events, first = [], [], None
        for k, x in enumerate(parts[: o.most_chunks]):
            if len(x) >= o.least_events:
                strands = collections.defaultdict(list)
                for ref, strand, cells in kept:
                    strands[ref, strand] += cells
                for h in hits[i, k]:
                    strands[h["ref_id"], h["strand"]].append((h["t"], h["q"] + len(events)))
                events += x
                found = brute.primaries(strands, events, refs, o)
                kept = [(c["ref_id"], c["strand"], c["anchors"]) for c in found]
                first = found[0] if found else None
            if (first and first["confident"]) or k + 1 == o.most_chunks:
                out[i] = (k + 1, *(first[c] if first else None for c in PLACES), bool(first and first["confident"]))
                break
    return out


def drained(writer, triggers):
    """Runs a stream until so many triggers with rows are over; timers keep it busy, so it doesn't end by itself."""
    q, end = writer.start(), time.time() + 120
    try:
        while time.time() < end and len({p["batchId"] for p in q.recentProgress if p["numInputRows"]}) < triggers and q.isActive:
            time.sleep(0.3)
        assert q.exception() is None and time.time() < end
    finally:
        q.stop()


PLACES = ["ref_id", "strand", "t_start", "t_end", "q_start", "q_end", "n_anchors", "mapq"]


@pytest.mark.parametrize("changes", [{}, {"least_aligned": None}, {"least_change": None, "w": 3}, {"least_aligned": None, "best_chains": 1, "ratio": 3.0}])
def test_streamed_decisions_equal_the_rules(spark, tmp_path, changes):
    o = options("viral", **{"least_aligned": 4.0, "least_events": 8, "most_chunks": 4, "least_anchors": 3, **changes})
    rng = np.random.default_rng(11)
    refs = {(i, s): np.repeat(rng.normal(0, 1.2, 160), rng.integers(1, 3, 160)).tolist() for i in range(3) for s in (0, 1)}  # flat pairs
    refs[1, 0][100:150] = refs[2, 1][50:100]
    refs_df = spark.createDataFrame([(i, s, x) for (i, s), x in refs.items()], f"ref_id long, strand int, {SIGNAL}")
    reads = {0: refs[1, 0][20:100], 1: refs[2, 1][40:140], 2: rng.normal(0, 1.2, 60).tolist(), 3: refs[0, 0][:24], 4: refs[1, 0][95:150] + refs[0, 1][10:80], 5: refs[0, 1][30:70] + [9.0] * 5 + refs[0, 1][70:150]}
    cut = {0: [20, 40, 60], 1: [30, 35, 60, 80], 2: [15, 30, 45], 3: [10, 20], 4: [20, 40, 70], 5: [40, 45, 90]}
    chunks = {i: [x[a:b] for a, b in zip([0, *cut[i]], [*cut[i], len(x)])] for i, x in reads.items()}
    want = replay(spark, chunks, refs, refs_df, o)
    kind = "read_id long, chunk int, events array<double>"
    for trigger, ks in enumerate([(0,), (1, 2), (3, 4)]):  # chunks of one trigger come in any order; read 5's last one is late
        rows = [(i, k, p[k]) for i, p in chunks.items() for k in reversed(ks) if k < len(p)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(i, 9, [0.0] * 20) for i in reads], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # late ones
    save_tiles(refs_df, str(tmp_path / "tiles"), 4096)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index = mapping.build_index(refs_df, o.e, o.w, o.least_change)
    found = map_chunks(stream, index, o, str(tmp_path / "tiles"), 3_600_000)
    drained(found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")), 4)
    got = {r["read_id"]: tuple(r[c] for c in ["chunks", *PLACES, "confident"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    late = {i for i in reads if i not in want}
    assert {i: x for i, x in got.items() if i not in late} == want and sum(x[-1] for x in want.values()) >= 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    states = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "kept").load()
    events = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "events").load()
    left = {r[0] for df in (states, events) for r in df.select("key.read_id").collect()}
    assert not left & set(got)  # decided reads have left the state


def test_one_chunk_decides_like_the_batch(spark, world, tmp_path):
    refs, reads = world
    o = options("viral", least_aligned=5.0, least_events=8, most_chunks=1)
    frame = spark.createDataFrame([(i, 0, s) for i, s in reads.items()], "read_id long, chunk int, events array<double>")
    frame.write.parquet(str(tmp_path / "in"))
    save_tiles(refs, str(tmp_path / "tiles"))
    found = map_chunks(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), mapping.build_index(refs, o.e, o.w, o.least_change), o, str(tmp_path / "tiles"))
    drained(found.writeStream.format("memory").queryName("one_chunk").option("checkpointLocation", str(tmp_path / "cp")), 1)
    names = [*PLACES, "confident"]
    batch = {r["read_id"]: tuple(r[c] for c in names) for r in map_reads(frame.select("read_id", F.col("events").alias("signal")), refs, o).collect()}
    got = {r["read_id"]: tuple(r[c] for c in names) for r in spark.table("one_chunk").collect()}
    assert got == {i: (*x[:-1], bool(x[-1])) for i, x in batch.items()} and sum(x[-1] for x in got.values()) >= 2


def test_idle_reads_leave(spark, world, tmp_path):
    refs, reads = world
    o = options("viral", least_aligned=None, least_events=8, most_chunks=9, least_anchors=1000)  # never decided
    kind = "read_id long, chunk int, events array<double>"
    spark.createDataFrame([(0, 0, reads[0])], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    found = map_chunks(stream, mapping.build_index(refs, o.e, o.w, o.least_change), o, idle_ms=500)
    q = found.writeStream.format("memory").queryName("idle_reads").option("checkpointLocation", str(tmp_path / "cp")).start()
    end = time.time() + 90
    while time.time() < end and spark.table("idle_reads").count() == 0:
        time.sleep(1)
    q.stop()
    row = spark.table("idle_reads").first()
    assert (row["read_id"], row["chunks"], row["confident"], row["ref_id"]) == (0, 1, False, None)


def test_run_until_stops_at_coverage(spark, tmp_path):
    refs = spark.createDataFrame([(1, 30)], "ref_id long, length long")
    for i in range(5):
        spark.createDataFrame([(1, 0, 14), (1, 10, 29)], "ref_id long, t_start int, t_end int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ref_id long, t_start int, t_end int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    each = lambda rows, batch: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}"))
    enough = lambda batch: region_coverage(spark.read.parquet(str(tmp_path / "out")), refs, 10).agg(F.min("coverage")).first()[0] >= 3
    assert run_until(stream, each, enough, str(tmp_path / "cp")) == 2


def test_coverage_counts_ends_and_bare_regions(spark):
    refs = spark.createDataFrame([(1, 25), (2, 0)], "ref_id long, length long")
    mapped = spark.createDataFrame([(1, 5, 12), (1, 9, 9), (1, 8, 7)], "ref_id long, t_start int, t_end int")
    got = [(r["region"], r["bases"], r["coverage"]) for r in region_coverage(mapped, refs, 10).orderBy("region").collect()]
    assert got == [(0, 6, 0.6), (1, 3, 0.3), (2, 0, 0.0)]


def test_abundance_settles(spark):
    step = spark.createDataFrame([(t, k, 10.0 * k) for t in range(7) for k in (1, 3)], "tick long, k long, b double")
    got = {r["tick"]: r["stop"] for r in tick_distances(step, 1e-6).collect()}
    assert got == {t: t >= 4 for t in range(7)}


def test_chunk_events_keep_their_keys(spark):
    rng = np.random.default_rng(2)
    signal = np.concatenate([np.full(30, v) for v in (50, 90, 60, 120)]) + rng.normal(0, 0.5, 120)
    got = chunk_events(spark.createDataFrame([(7, 1, signal.tolist()), (8, 0, None)], f"read_id long, chunk int, {SIGNAL}")).collect()
    assert {(r["read_id"], r["chunk"], len(r["events"]) > 0) for r in got} == {(7, 1, True), (8, 0, False)}
