"""What the findings of FINDINGS_r04.md were about, on the smallest tables that show it."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tracewarp.config import options
from tracewarp.functions.signal import expanding_levels
from tracewarp.operators import block_mapping, dtw, mapping
from tracewarp.plans import registry

from .test_round4 import SF


def test_paths_map_once(spark):
    """Mappings take long to make, and each is made once for its path."""
    wave = [float((i * i) % 7 - 3) for i in range(60)]
    reads = spark.createDataFrame([(i, wave[i : i + 40]) for i in range(6)], "read_id long, signal array<double>")
    refs = reads.select(F.col("read_id").alias("ref_id"), F.lit(0).alias("strand"), "signal")
    o = options("viral", least_aligned=0.0)
    best = mapping.map_reads(reads, refs, o, others_only=True)
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    found = mapping.with_path(best.withColumn("confident", F.lit(True)).mapInArrow(seen, best.schema), reads, refs, o).collect()
    assert made.value == len(found) == 6 and all(r["path"] for r in found)


def test_lists_are_chained_together_as_one_by_one():
    """Lists of any number of hits, beyond the limit of looking back too, have the chains that each has alone."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        k, n, wide = int(rng.integers(1, 70)), int(rng.integers(1, 6)), int(rng.integers(3, 60))
        o = options("viral", skips=int(rng.choice([2, 25])), far=int(rng.choice([10, 5000])), gap=int(rng.choice([5, 2000])), prune=bool(rng.integers(2)))
        lists = []
        for _ in range(n):
            t = rng.integers(0, wide, k)
            q = rng.integers(0, wide, k) if rng.random() < 0.5 else np.clip(t + rng.integers(-2, 3, k), 0, None)
            lists.append((t, q) if k == 1 else tuple(v[np.lexsort((q, t))] for v in (t, q)))
        f, pred = block_mapping.chain_alike(*(np.array([x[i] for x in lists]) for i in (0, 1)), o)
        found = block_mapping.ends_alike(f, pred, o)
        for i, (t, q) in enumerate(lists):
            alone = mapping.chain(t, q, o.e, o.band, o.gap, o.far, o.skips)
            assert np.array_equal(alone[0], f[i]) and np.array_equal(alone[1], pred[i])
            got = [(end[j], score[j], np.flatnonzero(members[j]).tolist()) for rows, end, score, members in found for j in np.flatnonzero(rows == i)]
            assert got == [(end, score, sorted(path)) for end, score, path in mapping.ends_of(*alone, o)[1]]


def test_blocks_map_copies_without_a_step_a_list(spark):
    """Copies of signals, a read and references of other strands, without an id or a signal: blocks map like hits, and no list is chained alone."""
    rng = np.random.default_rng(4)
    base = [rng.normal(0, 1.2, 64).tolist() for _ in range(6)]
    reads = spark.createDataFrame([(k * 10 + i, x) for k in range(3) for i, x in enumerate(base)] + [(90, None), (None, base[0])], "read_id long, signal array<double>")
    refs = reads.select(F.col("read_id").alias("ref_id"), (F.coalesce("read_id", F.lit(0)) % 2).cast("int").alias("strand"), "signal")
    o = options("viral", least_aligned=0.0)
    want = mapping.map_reads(reads, refs, o, others_only=True).orderBy("read_id").collect()
    assert mapping.map_reads(reads, refs, o, others_only=True, blocks=True).orderBy("read_id").collect() == want
    assert sum(r["ref_id"] is not None for r in want) == 18
    plan = block_mapping.block_chains(reads, refs, o, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # references come to the reads; hits and chains stay


def test_what_a_block_holds_changes_nothing(spark, monkeypatch):
    """Few hits at a time, and few chains that wait while others are dropped."""
    rng = np.random.default_rng(6)
    base = [rng.normal(0, 1.2, 64) for _ in range(4)]
    rows = spark.createDataFrame([(k * 10 + i, k % 2, (x + rng.normal(0, 0.05, 64)).tolist()) for k in range(8) for i, x in enumerate(base)], "id long, strand int, signal array<double>")
    o = options("viral", least_aligned=0.0)
    side = block_mapping._sketched(rows, o).toArrow().sort_by([("id", "ascending"), ("strand", "ascending")])
    found = []
    for hits, pending, step in ((1 << 22, 1 << 18, 100), (50, 1, 100), (50, 1, 3)):
        monkeypatch.setattr(block_mapping, "HITS", hits)
        monkeypatch.setattr(block_mapping, "PENDING", pending)
        block, out = block_mapping.Block(side, o, True), []
        for k in range(0, side.num_rows, step):
            out += block.meet(side.slice(k, step))
        found.append(sorted(str(r) for b in (*out, *block.rest()) for r in b.to_pylist()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 20


def test_banded_costs_of_equal_lengths_are_those_of_single_pairs():
    rng = np.random.default_rng(2)
    for n, m, radius in ((1, 1, 1), (2, 7, 1), (9, 9, 1), (30, 22, 3), (64, 64, 6), (12, 3, 2)):
        a, b = rng.normal(0, 1, (n, 20)), rng.normal(0, 1, (m, 20))
        want = [dtw.warp(x, y, False, radius, True) for x, y in zip(a.T, b.T, strict=True)]
        assert dtw.warp_alike(a, b, radius).tolist() == want and np.isfinite(want).all()
        assert np.allclose(dtw.warp_alike(a, b), [dtw.warp(x, y) for x, y in zip(a.T, b.T, strict=True)])


def test_expanding_deviations_are_summed_from_the_last_sample(spark, tmp_path):
    """User 755's first 380 of six-fold samples deviate by 39 in the mean, to which only the sum from the last one back is a bit short."""
    events = spark.read.parquet(f"{SF}/../sf0.1/events.parquet").where("user_id between 700 and 800")
    copies = events.crossJoin(spark.range(6)).select((F.col("event_id") + F.col("id") * 100_000).alias("event_id"), "ts", "user_id", "event_type", "value", "props")
    copies.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect(config={"threads": 1})  # several sum in whatever order they meet
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select user_id, pos, code from ({registry.ORACLES['expanding_norm']}) order by 1, 2").fetchall()
    assert [tuple(r) for r in registry.QUERIES["expanding_norm"](spark, str(tmp_path)).orderBy("user_id", "pos").collect()] == want
    x = np.array([r["value"] for r in copies.where("user_id = 755").orderBy("ts", "event_id").collect()])
    far = np.abs(x - 50)[:380]
    assert np.cumsum(far)[-1] / 380 > 39 > np.cumsum(far[::-1])[-1] / 380
    assert expanding_levels(x)[366] == 110
