"""What the third round's findings were about, on the smallest tables that show it."""

import glob
import os

import duckdb
import numpy as np

from tracewarp.plans import registry

SF = "/root/testdata/sf0.001"


def differing(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL that the other one hasn't, over tables that stand in for those of the smallest data set."""
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        t = os.path.basename(p)[:-8]
        if t in tables:
            tables[t].coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
            p = f"{tmp_path}/{t}.parquet/*.parquet"
            con.execute(f"create view {t} as select * from '{p}'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(str, d.astype(object).values.tolist()))
    assert len(want) > 0
    return rows(got), rows(want)


def test_warc_query_has_the_columns_of_its_sql(spark):
    from tracewarp.llm import warc

    assert warc.op12_warc(spark, SF).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def same_letters(spark):
    return spark.createDataFrame([(n, c * n) for n, c in ((60, "A"), (172, "C"), (213, "G"), (232, "T"), (143, "A"), (122, "C"))] + [(7, "ACGTTGCA" * 90)], "doc_id long, text string")


def test_signals_of_one_letter_are_constant(spark, tmp_path):
    """The mean of equal levels may be off by a bit, which isn't spread."""
    for k, name in enumerate(("expected_signal", "tiled_signal")):
        got, want = differing(spark, tmp_path / str(k), name, documents=same_letters(spark))
        assert got == want


def test_expanding_means_are_summed_in_order(spark, tmp_path):
    """User 414's first 40 samples have the mean 55, but their sum in order of time is a bit less: so it is for each of six copies, whatever rows meet first."""
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SF}/../sf0.1/events.parquet")
    copies = events.crossJoin(spark.range(6)).select(F.col("event_id") + F.col("id") * 100_000, "ts", (F.col("user_id") + F.col("id") * 100_000).alias("user_id"), "event_type", "value", "props")
    copies.withColumnRenamed(copies.columns[0], "event_id").write.parquet(str(tmp_path / "events.parquet"))
    x = np.array([r["value"] for r in events.where("user_id = 414").orderBy("ts", "event_id").collect()])[:40]
    mu = int(np.cumsum(x)[-1] / 40)
    mad = int(np.cumsum(np.abs(x - mu))[-1] / 40)
    want = [int((max(min((v - mu) / mad, 4), -4) + 4) * 32) for v in x[20:]]
    got = registry.QUERIES["expanding_norm"](spark, str(tmp_path)).where("user_id % 100000 = 414 and pos between 20 and 39").orderBy("user_id", "pos").collect()
    assert mu == 54 and [r["code"] for r in got] == want * 6


def test_expanding_levels_by_brute_force():
    from tracewarp.functions.signal import expanding_levels

    x = np.random.default_rng(5).normal(60, 20, 75).round(2)
    x[30] = np.nan
    got = expanding_levels(x)
    for i, v in enumerate(x):
        seen = x[: (i // 20 + 1) * 20]
        seen = seen[~np.isnan(seen)]
        mu = int(seen.mean())
        mad = max(int(np.abs(seen - mu).mean()), 1)
        assert got[i] == (256 if np.isnan(v) else int((max(min((v - mu) / mad, 4), -4) + 4) * 32))


def test_differences_of_texts(spark):
    from pyspark.sql import functions as F

    from tracewarp.functions.seq import clean, differences

    rows = [("ACGT", "ACGT"), ("ACGT", "AGGTA"), ("", ""), ("GG", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(differences(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0, 2, 0, 2]
    assert spark.createDataFrame([("a, cgu!\nxXt",)], "t string").select(clean(F.col("t"))).first()[0] == "ACGTT"


def test_a_piece_offers_its_smallest_places_only(spark):
    """The chosen places are the n smallest of a sequence however it is cut, and no list of a piece's places is joined."""
    from tracewarp.operators import mutate

    refs = spark.createDataFrame([(1, "ACGT" * 2000), (2, "ACG")], "ref_id long, seq string")
    found = [{(r["ref_id"], r["at"] + r["i"], r["h"]) for r in mutate.sampled_places(mutate.pieces(refs, size), 20).collect()} for size in (64, 1000, 9000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 23
    plan = mutate.sampled_places(mutate.pieces(refs), 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_blocks_map_like_hits(spark):
    """Blocks of reads and references give the mappings and counts that single hits give."""
    from pyspark.sql import functions as F

    from tracewarp.config import options
    from tracewarp.operators import mapping

    rng = np.random.default_rng(11)
    base = rng.normal(0, 1.2, 90)
    rows = [(i, (np.concatenate([rng.normal(0, 1.2, 10), base[i : i + 50]]) + rng.normal(0, 0.03, 60)).tolist()) for i in range(30)] + [(30, []), (31, [0.7, -0.7] * 40), (32, [0.7, -0.7] * 45)]
    reads = spark.createDataFrame(rows, "read_id long, signal array<double>")
    refs = reads.select(F.col("read_id").alias("ref_id"), (F.col("read_id") % 2).cast("int").alias("strand"), "signal")
    for o in (options("viral", least_aligned=0.0), options("viral", least_aligned=0.0, least_change=None, prune=False), options("faster", e=5, w=3, least_aligned=None)):
        both = [mapping.map_reads(reads, refs, o, others_only=True, blocks=b).orderBy("read_id").collect() for b in (False, True)]
        assert both[0] == both[1] and sum(r["ref_id"] is not None for r in both[0]) > 10
        hits = mapping.anchors(reads, mapping.build_index(refs, o.e, o.w, o.least_change), o.e, o.w, o.least_change).where("read_id != ref_id")
        want = {tuple(r) for r in hits.groupBy("read_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("ref_id")).collect()}
        assert {tuple(r) for r in mapping.hit_counts(reads, refs, o, others_only=True).collect()} == want


def test_the_least_cost_is_no_more_than_the_cost():
    from tracewarp.operators.dtw import warp
    from tracewarp.operators.mapping import least_cost

    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = rng.normal(0, 1, rng.integers(2, 9)), rng.normal(0, 1, rng.integers(2, 9))
        for radius in (None, 1):
            assert least_cost(x, y) <= warp(x, y, False, radius, True) - abs(x[-1] - y[-1]) + 1e-9


def test_all_trusted_rows_are_counted_or_held(spark):
    """Without a bound by the caller no trusted row is left out of both the model and the thresholds."""
    import inspect

    from tracewarp.llm import quality_classifier

    assert inspect.signature(quality_classifier.perplexities).parameters["max_trusted"].default is None
    docs = spark.createDataFrame([(i if i < 60 else None, "en", f"plain words number {i} go here") for i in range(64)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    found = quality_classifier.perplexities(docs, labels).collect()
    roles = {r["doc_id"]: r["role"] for r in found if r["doc_id"] is not None}
    assert len(found) == 64 and {i for i, r in roles.items() if r} == set(range(50)) and {1, 2} <= set(roles.values())


def test_the_popcount_grid_proposes_near_duplicates(spark):
    from tracewarp.llm import minhash_dedup

    nodes = spark.createDataFrame([(1, 0), (2, 3), (3, 1 << 40 | 1 << 3), (4, 0b11111), (5, 3)], "node long, fp long")
    got = {frozenset((r["node"], r["hub"])) for r in minhash_dedup.grid_pairs(nodes).collect()}
    assert got == {frozenset(p) for p in ((1, 2), (1, 3), (2, 5))}
