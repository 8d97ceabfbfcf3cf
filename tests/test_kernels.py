import numpy as np
import pytest

from tracewarp.operators.dtw import bonus_many, path, warp, warp_many
from tracewarp.operators.events import detect
from tracewarp.operators.mapping import chain


def naive(a, b, free=False):
    c = np.full((len(a) + 1, len(b) + 1), np.inf)
    c[0, 0] = 0
    if free:
        c[0, :] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            c[i, j] = abs(a[i - 1] - b[j - 1]) + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    return c[-1, 1:].min() if free else c[-1, -1]


@pytest.mark.parametrize("n, m", [(4, 4), (10, 10), (20, 10), (25, 10), (100, 100), (200, 50), (200, 30), (1, 5)])
def test_warp_equals_the_full_matrix(n, m):
    rng = np.random.default_rng(n * m)
    for _ in range(5):
        a, b = rng.uniform(-2.5, 2.5, n), rng.uniform(-2.5, 2.5, m)
        assert warp(a, b) == pytest.approx(naive(a, b), abs=1e-6)
        assert warp(a, b, free=True) == pytest.approx(naive(a, b, True), abs=1e-6)
        assert warp(a, b, radius=max(n, m)) == pytest.approx(naive(a, b), abs=1e-6)
        for free in (False, True):
            cost, cells = path(a, b, free)
            assert cost == pytest.approx(naive(a, b, free), abs=1e-6) == pytest.approx(sum(d for _, _, d in cells), abs=1e-6)
            assert {(y[0] - x[0], y[1] - x[1]) for x, y in zip(cells, cells[1:])} <= {(0, 1), (1, 0), (1, 1)}
            assert cells[0][0] == 0 and cells[-1][0] == n - 1


def banded(a, b, radius):
    """Cells within the radius of the slanted diagonal only, the longer signal as rows."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    reach = radius + int(np.ceil((len(a) - len(b)) * radius / len(a)))
    c = np.full((len(a) + 1, len(b) + 1), np.inf)
    c[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(j - 1 - len(b) * (i - 1) // len(a)) <= reach:
                c[i, j] = abs(a[i - 1] - b[j - 1]) + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    return c[-1, -1]


def test_signals_of_many_lengths_share_a_batch():
    rng = np.random.default_rng(8)
    a = [rng.uniform(-2.5, 2.5, n) for n in (3, 9, 14, 1, 6)]
    b = [rng.uniform(-2.5, 2.5, n) for n in (5, 9, 4, 7, 12)]
    assert warp_many(a, b) == pytest.approx([naive(x, y) for x, y in zip(a, b)])
    assert warp_many(a, b, free=True) == pytest.approx([naive(x, y, True) for x, y in zip(a, b)])
    for r in (1, 2, 3):
        assert warp_many(a, b, radius=r) == pytest.approx([banded(x, y, r) for x, y in zip(a, b)])
    assert warp_many([np.zeros(0), a[0]], [b[0], np.zeros(0)]).tolist() == [np.inf, np.inf]


def test_bonus_equals_cell_by_cell():
    rng = np.random.default_rng(4)
    s, r = [rng.uniform(0, 40, n) for n in (5, 8, 2)], [rng.uniform(0, 40, n) for n in (9, 4, 6)]

    def plain(x, y):
        c, n = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
        c[:, 0] = np.abs(x - y[0]).cumsum()
        for j in range(1, len(y)):
            for i in range(1, len(x)):
                d, u = c[i - 1, j - 1] - 10 * n[i - 1, j - 1], c[i - 1, j]
                c[i, j] = min(d, u) + abs(x[i] - y[j])
                n[i, j] = 0 if d < u else min(10, n[i, j - 1] + 1)
        return c[-1].min()

    assert bonus_many(s, r) == pytest.approx([plain(x, y) for x, y in zip(s, r)])


def test_detect_finds_steps():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(30, v) for v in (50, 90, 60, 120)]) + rng.normal(0, 0.5, 120)
    assert 2 <= len(detect(x)) <= 6
    assert len(detect(np.zeros(3))) == 0


def test_chain_follows_a_diagonal():
    t = np.arange(0, 100, 5)
    f, pred = chain(t, t.copy())
    assert f[-1] == max(f) and list(pred[1:]) == list(range(len(t) - 1))


def test_diagonal_band_misses_a_corner_outside():
    from tracewarp.operators.dtw import warp, warp_many

    rng = np.random.default_rng(5)
    a, b = rng.random(12), rng.random(9)
    assert warp_many([a], [b], False, 2, False)[0] == np.inf
    full = warp_many([a], [b], False, 12, False)[0]
    assert full == pytest.approx(warp(a, b)) and warp_many([a], [b], False, 3, False)[0] >= full


def test_greedy_outlier_follows_the_slots(spark):
    from pyspark.sql import functions as F

    from tracewarp.operators.abundance import greedy_outlier

    def brute(vs):
        at, far = vs[0], 0.0
        for v in vs:
            d = sum((x - y) ** 2 for x, y in zip(v, at, strict=True))
            if d > far:
                at, far = v, d
        return far

    rng = np.random.default_rng(9)
    sets = [rng.random((5, 3)).tolist() for _ in range(20)] + [[[0.5, 0.5]]]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, v array<array<double>>").select("i", greedy_outlier(F.col("v")).alias("d")).collect()
    assert {r.i: pytest.approx(r.d) for r in got} == {i: brute(s) for i, s in enumerate(sets)}
