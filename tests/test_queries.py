import glob
import os
import time

import duckdb
import pandas as pd
import pytest

from tracewarp.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(frame):
    number = lambda v: None if pd.isna(v) else round(float(v), 4) if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)
    return sorted(str([number(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got) > 0
        return
    assert rows(got) == rows(duck.execute(registry.ORACLES[name]).df())


def test_entry_imports():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_stream_decides_like_the_batch(spark, tmp_path):
    import numpy as np

    from tracewarp.operators.dtw import warp
    from tracewarp.streaming.decide import stage_decisions

    template, rng = [1.0, 5.0, 2.0, 8.0], np.random.default_rng(3)
    signals = {i: rng.uniform(0, 9, 12).tolist() for i in range(4)}
    data = [(i, k, s[6 * k : 6 * k + 6]) for i, s in signals.items() for k in range(2)]
    spark.createDataFrame(data, "read_id long, chunk int, signal array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id long, chunk int, signal array<double>").parquet(str(tmp_path / "in"))
    q = stage_decisions(stream, template, [(6, 1e9), (12, 20.0)]).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    deadline = time.time() + 120  # idle reads keep such a stream busy, so it doesn't end by itself
    while q.isActive and spark.table("decided").count() < 4 and time.time() < deadline:
        time.sleep(1)
    q.stop()
    got = {r["read_id"]: r for r in spark.table("decided").collect()}
    for i, s in signals.items():
        assert got[i]["seen"] == 12 and got[i]["cost"] == pytest.approx(warp(np.array(s), np.array(template), free=True))


def test_fasta_round_trip(spark, tmp_path):
    from tracewarp.sources.files import read_fasta, write_fasta

    refs = spark.createDataFrame([("a", "ACGU"), ("b", "GGT")], "name string, seq string")
    write_fasta(refs, str(tmp_path / "f"))
    assert {(r["name"], r["seq"]) for r in read_fasta(spark, str(tmp_path / "f")).collect()} == {("a", "ACGT"), ("b", "GGT")}
