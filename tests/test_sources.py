import pytest
from pyspark.sql import functions as F

from tracewarp.config import amount, options
from tracewarp.functions.seq import common_prefix
from tracewarp.functions.signal import limit_outliers
from tracewarp.operators import expected, mapping, ranking
from tracewarp.operators.ranking import ordered_rank
from tracewarp.sources import files, paf


def test_presets():
    assert options("faster").w == 5 and options("viral", e=8).e == 8 and options().e == 6
    assert [amount(x) for x in ("500M", "4G", "12")] == [500_000_000, 4_000_000_000, 12]
    with pytest.raises(ValueError):
        options(e=0)


def test_fastq_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([("a", "ACGT", "@III"), ("b", "GG", "##")], "read_id string, seq string, qual string").coalesce(1)
    files.write_fastq(reads, str(tmp_path / "q"))
    got = files.read_fastq(spark, str(tmp_path / "q"))
    assert sorted(map(tuple, got.select("nth", "read_id", "seq", "qual").collect())) == [(0, "a", "ACGT", "@III"), (1, "b", "GG", "##")]
    assert files.lock_step(got, got.where("nth = 0")).count() == 1


def test_sam_text(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 7, 4, 60, "3M", "AAC", "123"), ("b", None, None, None, None, None, "GG", "##")], "read_id string, strand int, ref_id long, t_start int, mapq int, cigar string, seq string, qual string")
    files.write_sam(rows, spark.createDataFrame([(7, 50)], "ref_id long, len int"), str(tmp_path / "s"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "s")).collect() if not r.value.startswith("@"))
    assert lines == ["a\t16\t7\t5\t60\t3M\t*\t0\t0\tGTT\t321", "b\t4\t*\t0\t0\t*\t*\t0\t0\tGG\t##"]


def test_metrics(spark, tmp_path):
    (tmp_path / "r.txt").write_text("F1: 0.5\nnothing here\nmean time = 12\n")
    assert {(r.metric, r.value) for r in files.read_metrics(spark, str(tmp_path / "r.txt")).collect()} == {("F1", 0.5), ("mean time", 12.0)}


def test_ranks_with_nulls_and_few_rows(spark):
    rows = spark.createDataFrame([(5,), (None,), (2,), (9,)], "k int")
    assert {(r.k, r["rank"]) for r in ordered_rank(rows, "k").collect()} == {(None, 1), (2, 2), (5, 3), (9, 4)}
    assert ordered_rank(rows.limit(0), "k").count() == 0


def test_folds(spark):
    row = spark.range(1).select(common_prefix(F.array(F.lit("tool_a"), F.lit("tool_b"), F.lit("tool"))).alias("p"), limit_outliers(F.array(*map(F.lit, [0.0, 9.0, 2.0, 5.0, 6.0, 1.0]))).alias("s")).first()
    assert row.p == "tool" and row.s == [0.0, 1.0, 2.0, 4.0, 2.5, 1.0]


def test_vectors_keep_their_order(spark, tmp_path):
    (tmp_path / "virus_raw0.txt").write_text("3\n1\n2\n")
    assert [(r.file, r.signal) for r in files.read_vectors(spark, str(tmp_path)).collect()] == [("virus_raw0.txt", [3, 1, 2])]


def test_pore_models_of_two_and_five_columns(spark, tmp_path):
    (tmp_path / "five.tsv").write_text("#note\nkmer\tlevel_mean\tlevel_stdv\tsd_mean\tsd_stdv\nACG\t80.5\t1.5\t2\t3\nUTT\t90\t1\t1\t1\n")
    (tmp_path / "two.tsv").write_text("AANC\t7.25\n")
    assert sorted(map(tuple, files.read_pore_model(spark, str(tmp_path / "five.tsv")).collect())) == [("ACG", 6, 80.5, 1.5, 2.0, 3.0), ("UTT", 63, 90.0, 1.0, 1.0, 1.0)]
    assert tuple(files.read_pore_model(spark, str(tmp_path / "two.tsv")).first()) == ("AANC", 1, 7.25, None, None, None)


def test_fastq_in_many_splits(spark, tmp_path):
    reads = [(f"r{i}", "ACGT" * (1 + i % 7), "@" * (4 + i % 7 * 4)) for i in range(500)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\r\n{s}\r\n+\r\n{q}\r\n" for n, s, q in reads) + "@cut\r\nAC\r\n")
    (tmp_path / "b.fq").write_text("@z\nUU\n+\nII")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        got = files.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.nth, r.read_id, r.seq, r.qual) for r in got if r.file.endswith("a.fq")) == [(i, *x) for i, x in enumerate(reads)]
    assert [(r.nth, r.read_id, r.seq, r.qual) for r in got if r.file.endswith("b.fq")] == [(0, "z", "TT", "II")]


def test_lock_step_pairs_files_in_order(spark):
    kind = "file string, nth long, read_id string, seq string"
    one = spark.createDataFrame([("a1", 0, "x", "A"), ("b1", 0, "y", "C"), ("b1", 1, "v", "T")], kind)
    two = spark.createDataFrame([("a2", 0, "x", "G"), ("b2", 0, "y", "T")], kind)
    assert sorted(map(tuple, files.lock_step(one, two).select("read_id_1", "read_id_2", "seq_2").collect())) == [("x", "x", "G"), ("y", "y", "T")]


def test_decisions_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([(True, "f", "r1", 2000, 12.5, False)], "is_target boolean, source string, read_id string, final_len int, last_score double, keep boolean").coalesce(1)
    files.write_decisions(rows, str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ["is_target\tsource\tread_id\tfinal_len\tlast_score\tkeep", "true\tf\tr1\t2000\t12.5\tfalse"]
    (tmp_path / "c.csv").write_text("World,2021-3-4,7\nWorld,2021-03-05,\n")
    assert [(r.place, str(r.day), r.value) for r in files.read_daily_counts(spark, str(tmp_path / "c.csv")).orderBy("day").collect()] == [("World", "2021-03-04", 7.0), ("World", "2021-03-05", None)]


def test_paf_columns(spark):
    kind = "read_id long, ref_id long, strand int, score double, aligned double, n_anchors int, t_start int, t_end int, q_start int, q_end int, n int, s2 double, mean double, score_s2 double, score_mean double, mapq int, confident boolean, anchors array<struct<t:int,q:int>>"
    cells = [{"t": 30, "q": 10}, {"t": 40, "q": 20}, {"t": 69, "q": 50}]
    found = spark.createDataFrame([(1, 7, 1, 20.0, 18.0, 3, 30, 69, 10, 50, 2, 9.0, 13.5, 12.0, 16.0, 20, True, cells), (2, 7, 0, 20.0, 18.0, 3, 30, 69, 10, 50, 2, 17.0, 17.5, 19.0, 19.5, 2, False, cells), (3, *[None] * 17)], kind)
    reads = spark.createDataFrame([(i, 8000, 90) for i in (1, 2, 3)], "read_id long, samples long, events int")
    refs = spark.createDataFrame([(7, 1000)], "ref_id long, len int")
    lines = paf.paf_lines(paf.paf_rows(found, reads, refs))
    text = {r.value.split("\t")[0]: r.value.split("\t") for r in lines.collect()}
    assert text["1"][:12] == ["1", "500", "100", "500", "-", "7", "1000", "932", "972", "399", "40", "20"]
    assert text["1"][12:] == ["mt:f:0.000000", "ci:i:1", "sl:i:8000", "cm:i:3", "nc:i:2", "s1:f:20.000000", "s2:f:12.000000", "sm:f:16.000000", "at:f:13.000000", "aq:f:13.333333", "anchors:s:(50,69)(20,40)(10,30)"]
    assert text["2"][:12] == ["2", "900", *["*"] * 9, "0"] and text["2"][15] == "cm:i:3"
    assert text["3"][:12] == ["3", "900", *["*"] * 9, "0"] and text["3"][15:] == ["cm:i:0", "nc:i:0", "s1:f:0", "s2:f:0", "sm:f:0", "at:f:0", "aq:f:0"]
    back = {r.qname: r for r in paf.parse_paf(lines.union(spark.createDataFrame([("a\tfew",)], "value string"))).collect()}
    assert set(back) == {"1", "2", "3"} and back["1"].tstart == 932 and back["3"].tstart is None
    assert [(c.q, c.t) for c in back["1"].anchors] == [(50, 69), (20, 40), (10, 30)] and back["2"].anchors is None and back["3"].anchors is None and back["1"].aln is None
    path = paf.parse_paf(spark.createDataFrame([("\t".join(["r", *"*" * 11, "aln:s:(0,1,0.5)(1,1,2)", "x:i:1", "x:i:2"]),)], "value string")).first()
    assert [tuple(c) for c in path.aln] == [(0, 1, 0.5), (1, 1, 2.0)] and path.tags["x"] == "2"


def test_anchor_log_meets_mappings(spark):
    hits = spark.createDataFrame([(1, 7, 1, 30, 10), (1, 7, 1, 5030, 12), (1, 8, 0, 3, 4)], "read_id long, ref_id long, strand int, t int, q int")
    lines = paf.anchor_lines(hits)
    assert {r.value for r in lines.collect()} >= {"readname=1 refname=8 strand=0 anchors=(4,3)"}
    rows = paf.parse_anchor_lines(lines.union(spark.createDataFrame([("other line",), (None,)], "value string")))
    assert sorted(map(tuple, rows.collect())) == [("1", "7", "-", 10, 30), ("1", "7", "-", 12, 5030), ("1", "8", "+", 4, 3)]
    line = "\t".join(["1", "9", "0", "9", "-", "7", "99", "0", "9", "9", "9", "60", "anchors:s:(10,30)"])
    met = paf.anchors_of_mappings(rows, paf.parse_paf(spark.createDataFrame([(line,)], "value string")))
    assert sorted((r.q, r.chained) for r in met.collect()) == [(10, True), (12, False)]


def test_index_tables(spark):
    refs = spark.createDataFrame([(0, 0, [float((i * 7) % 11) for i in range(40)])], "ref_id long, strand int, signal array<double>")
    o = options("viral", least_change=None)
    index = mapping.build_index(refs, o.e, o.w, o.least_change)
    for t in ("", "_refs", "_meta"):
        spark.sql(f"drop table if exists some_index{t}")
    mapping.save_index(index, refs, "some_index", o, 4)
    try:
        back, lengths, kept = mapping.load_index(spark, "some_index")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.collect())) and lengths.first().length == 40 and (kept.e, kept.least_change) == (5, None)
        reads = spark.createDataFrame([(1, [float((i * 7) % 11) for i in range(5, 30)])], "read_id long, signal array<double>")
        assert mapping.anchors(reads, back, kept.e, kept.w, kept.least_change).where("t - q = 5").count() > 10
        spark.sql("drop table some_index_meta")
        spark.createDataFrame([("other", 1, 5, 0, None)], "format string, version int, e int, w int, least_change double").write.saveAsTable("some_index_meta")
        with pytest.raises(ValueError):
            mapping.load_index(spark, "some_index")
    finally:
        for t in ("", "_refs", "_meta"):
            spark.sql(f"drop table if exists some_index{t}")


def test_expected_levels_of_odd_sequences(spark):
    model = spark.createDataFrame([(0, 10.0), (1, 20.0), (14, 40.0)], "code long, level_mean double")
    refs = spark.createDataFrame([("x", "AACN"), ("short", "A"), ("none", None)], "ref_id string, seq string")
    got = {(r.ref_id, r.strand): r.signal for r in expected.expected_signals(refs, model, 2).collect()}
    assert got["x", 0] == pytest.approx([(v - 10) / 200**0.5 * 3**0.5 for v in (10, 20, 0)]) and got["short", 0] == []
    # levels 10, 20 and 0 (CA has none); their mean is 10 and their deviation the root of 200 / 3
    flat = {r.ref_id: r.signal for r in expected.stepped_reference(refs, model, 2, both=False).collect()}
    assert len(flat["x"]) == 4 and flat["x"][2] == flat["x"][3] and "none" not in flat


def test_draws_and_shuffles_are_repeatable(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    one, two = (sorted(map(tuple, ranking.drawn(r, "k", 200, 3).select("draw", "k").collect())) for r in (rows, rows.repartition(5)))
    assert one == two and len(one) == 200 and len({k for _, k in one}) < 200
    assert ranking.drawn(rows.limit(0), "k", 5, 3).count() == 0
    order = [r.k for r in ranking.shuffled(rows, "k", 80, 1).collect()]
    assert sorted(order) == list(range(50)) != order


def test_sam_is_one_file(spark, tmp_path):
    kind = "read_id string, strand int, ref_id string, t_start int, mapq int, cigar string, seq string, qual string, q_start int, q_end int, nm int, md string"
    rows = [("a", 0, "r1", 9, 60, "3M", "ACGTA", "!#$%&", 1, 4, 0, "3"), ("b", 1, "r1", 0, 7, "4M", "AACGT", "!#$%&", 1, 5, 1, "4"), ("c", None, None, None, None, None, "AC", "!!", None, None, None, None), ("d", 1, "r2", 3, 9, "2M", "AC", "!#", 0, 2, 0, "2")]
    refs = spark.createDataFrame([("r2", 20), ("r1", 30)], "ref_id string, len int")
    files.write_sam(spark.createDataFrame(rows, kind).repartition(3), refs, str(tmp_path / "s"))
    parts = sorted(p for p in (tmp_path / "s").iterdir() if p.name.startswith("part"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[:4] == ["@HD\tVN:1.6\tSO:unknown", "@SQ\tSN:r1\tLN:30", "@SQ\tSN:r2\tLN:20", "@PG\tID:tracewarp\tPN:tracewarp"] and len(lines) == 8
    by = {x.split("\t")[0]: x.split("\t")[1:] for x in lines[4:]}
    assert by["a"] == ["0", "r1", "10", "60", "1S3M1S", "*", "0", "0", "ACGTA", "!#$%&", "NM:i:0", "MD:Z:3"]
    assert by["b"] == ["16", "r1", "1", "7", "4M1S", "*", "0", "0", "ACGTT", "&%$#!", "NM:i:1", "MD:Z:4"]
    assert by["c"] == ["4", "*", "0", "0", "*", "*", "0", "0", "AC", "!!"] and by["d"][4] == "2M"


def test_times_of_reads(spark):
    form = lambda name, ref, n, mt, ci, rf, scores: "\t".join([name, str(n), *["*"] * 3, ref, *["*"] * 6, f"mt:f:{mt}", f"ci:i:{ci}", *(["cm:i:3"] if scores else []), f"rf:Z:{rf}"])
    lines = [("a", "r", 100, 8.0, 2, "tp", True), ("b", "r", 300, 9.0, 3, "na", True), ("c", "*", 50, 4.0, 1, "fn", True), ("d", "*", 70, 6.0, 1, "tn", False)]
    paf_rows = paf.parse_paf(spark.createDataFrame([(form(*x),) for x in lines] + [("e\t5" + "\t*" * 10 + "\tmt:f:99",)], "value string"))
    got = paf.read_times(paf_rows).first().asDict()
    assert got == {"mean_chunk_time": pytest.approx(11 / 3), "median_chunk_time": 4.0, "mean_time": 6.0, "median_time": 6.0, "bases_mapped": 200.0, "chunks_mapped": 2.5, "bases_unmapped": 50.0, "chunks_unmapped": 1.0, "bases_all": 150.0, "chunks_all": 2.0}
    assert set(paf.read_times(paf_rows.limit(0)).first()) == {float("inf")}


def test_names_of_runs(spark):
    from tracewarp.functions import seq

    names = ["sensitive_dtwfillmethod_banded=0.25_dtwborderconstraint_sparse", "fast_dtwborderconstraint_global_x", "plain"]
    got = spark.createDataFrame([(x,) for x in names], "n string").select(seq.run_settings(F.col("n")).alias("s"), seq.named(F.col("n"), [("fast", "Fast"), ("a", "A")]).alias("t")).collect()
    assert [tuple(r["s"]) for r in got] == [("sensitive", "banded=0.25", 0.25, "sparse"), ("fast", None, None, "global"), ("plain", None, None, None)]
    assert [r["t"] for r in got] == ["A", "Fast", "A"]


def test_interpolation(spark):
    import numpy as np

    from tracewarp.functions.signal import interpolated

    rng = np.random.default_rng(1)
    x, y, at = np.sort(rng.choice(100, 20, replace=False)).astype(float), rng.normal(0, 1, 20), np.concatenate([rng.uniform(-10, 110, 50), [5.0]])
    points = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "k int, x double, y double")
    places = spark.createDataFrame([(1, float(a)) for a in at] + [(1, float(x[3])), (2, 4.0)], "k int, x double")
    got = {(r["k"], r["x"]): r["y"] for r in interpolated(points, places, "k").collect()}
    assert got.pop((2, 4.0)) is None and all(v == pytest.approx(np.interp(a, x, y)) for (_, a), v in got.items()) and len(got) == 52
