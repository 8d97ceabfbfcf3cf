"""What the findings of FINDINGS_r03.md that were left were about, on the smallest tables that show it."""

from pyspark.sql import functions as F

from tracewarp.operators import mapping
from tracewarp.plans import frame_queries
from tracewarp.sources import paf

from .test_round4 import SF, differing


def test_anchor_log_grows_with_its_seeds(spark, tmp_path, monkeypatch):
    """Thirty copies of each vector: their hits are as many as the square of the copies, the log's anchors no more than the seeds."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 20")
    copies = rows.crossJoin(spark.range(30)).select((F.col("vec_id") + F.col("id") * 100_000).alias("vec_id"), "embedding", "label")
    logged = []
    lines = paf.anchor_lines
    monkeypatch.setattr(frame_queries.paf, "anchor_lines", lambda hits: logged.append(hits) or lines(hits))
    got, want = differing(spark, tmp_path, "anchor_log", embeddings=copies)
    seeds = copies.select(F.sum(F.size("embedding") - 5)).first()[0]
    assert got == want and len(got) == copies.count()
    assert logged[0].count() == seeds


def test_hits_by_classes_are_all_hits(spark):
    """Both strands, a reference and a read that come twice, ids without a value, reads that are no references."""
    wave = lambda k, n: [float((i * k) % 7 - 3) for i in range(n)]
    refs = spark.createDataFrame([(1, 0, wave(3, 20)), (1, 1, wave(5, 20)), (2, 0, wave(3, 12)), (2, 0, wave(2, 12)), (3, 1, wave(3, 9)), (None, 0, wave(3, 9)), (4, 0, None)], "ref_id long, strand int, signal array<double>")
    reads = spark.createDataFrame([(1, wave(3, 15)), (2, wave(5, 15)), (2, wave(3, 8)), (9, wave(2, 10)), (None, wave(3, 10)), (4, None)], "read_id long, signal array<double>")
    index = mapping.build_index(refs)
    classes = mapping.seed_classes(index)
    logged = paf.parse_anchor_lines(paf.anchor_lines(mapping.class_anchors(reads, classes)))
    every = mapping.anchors(reads, index).where("read_id is not null and ref_id is not null")
    for others in (False, True):
        want = every.where("read_id != ref_id") if others else every
        want = want.groupBy(F.col("read_id").cast("string"), "strand").agg(F.count(F.lit(1)), F.sum("q"), F.sum("t"))
        got = mapping.class_hits(logged, classes, others_only=others)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 3


def test_texts_of_the_classifier_stay_where_they_are(spark, tmp_path):
    """Where trusted ids are too many to be broadcast, the rows with texts aren't shuffled to meet them. Roles are those of the ids."""
    import zlib

    from tracewarp.llm import quality_classifier

    n = 200
    rows = [(i, "en", f"text {i} of some words") for i in range(n)] + [(None, "en", "no id"), (3, "en", "again")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    docs = spark.read.parquet(str(tmp_path / "d"))
    sent = []

    def shuffled(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "doc_id" in line]

    def chunks(given, *rest):
        sent.extend(shuffled(given))
        return made(given, *rest)

    made = quality_classifier._chunks
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    quality_classifier._chunks = chunks
    try:
        found = quality_classifier.perplexities(docs, labels, order=2).collect()
    finally:
        quality_classifier._chunks = made
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sent == [] and len(found) == n + 2
    of = lambda i: 0 if i is None or i % 4 == 0 or i % 5 == 0 else quality_classifier.HELD if zlib.crc32(str(i).encode()) % 5 == 0 else quality_classifier.TRAIN
    assert all(r["role"] == of(r["doc_id"]) for r in found) and {r["role"] for r in found} == {0, 1, 2}
