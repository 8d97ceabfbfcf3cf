import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from tracewarp.functions.sketch import seeds_of, sketch
from tracewarp.operators.dtw import warp
from tracewarp.plans import sql_functions


@pytest.fixture(scope="module")
def pairs(spark):
    sql_functions.register(spark)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, n).tolist(), rng.normal(0, 1, m).tolist(), r) for i, (n, m, r) in enumerate([(9, 9, 1), (12, 5, 2), (5, 12, 3), (30, 28, 2), (1, 1, 1)])]
    spark.createDataFrame([*rows, (90, None, [1.0], 1), (91, [1.0], None, 1)], "id int, a array<double>, b array<double>, r int").createOrReplaceTempView("pairs_of_signals")
    return rows


def test_scalar_functions(spark, pairs):
    got = {r["id"]: r for r in spark.sql("SELECT id, dtw_global(a, b) g, dtw_banded(a, b, r) d, sdtw(a, b) s, detect_events(a) e FROM pairs_of_signals").collect()}
    for i, a, b, r in pairs:
        assert (got[i]["g"], got[i]["d"], got[i]["s"]) == pytest.approx((brute.banded_cost(a, b), brute.banded_cost(a, b, r), warp(np.array(a), np.array(b), True)))
        assert got[i]["e"] is not None
    assert [got[90][c] for c in "gdse"] == [None] * 4 and [got[91][c] for c in "gds"] == [None] * 3


def test_table_functions(spark, pairs):
    cells = spark.sql("SELECT p.id, c.step, c.i, c.j, c.d FROM pairs_of_signals p, LATERAL dtw_path(p.a, p.b) c").collect()
    for i, a, b, _ in pairs:
        mine = sorted((c["step"], c["i"], c["j"], c["d"]) for c in cells if c["id"] == i)
        assert sum(c[-1] for c in mine) == pytest.approx(brute.banded_cost(a, b)) and mine[0][1:3] == (0, 0) and mine[-1][1:3] == (len(a) - 1, len(b) - 1)
    assert not {90, 91} & {c["id"] for c in cells}
    with pytest.raises(Exception, match="array of numbers"):
        spark.sql("SELECT * FROM sketch('text', 3)").collect()
    with pytest.raises(Exception, match="constants"):
        spark.sql("SELECT s.* FROM pairs_of_signals p, LATERAL sketch(p.a, p.r) s").collect()


@pytest.mark.parametrize(("w", "least"), [(0, None), (0, 0.4), (3, None), (4, 0.7)])
def test_sketches_are_the_same_in_both_forms(spark, w, least):
    rng = np.random.default_rng(w)
    rows = [(i, rng.normal(0, 1.5, n).tolist()) for i, n in enumerate((0, 2, 3, 5, 40, 200))] + [(9, [0.0] * 20)]
    df = spark.createDataFrame(rows, "id int, a array<double>")
    want = {r["id"]: [(x["pos"], x["hash"]) for x in r["s"]] for r in df.select("id", sketch(F.col("a"), 3, w, least).alias("s")).collect()}
    for i, a in rows:
        pos, hashes = seeds_of(np.array(a), 3, w, least)
        assert list(zip(pos.tolist(), hashes.tolist())) == want[i]
