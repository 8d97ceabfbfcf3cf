"""The mapper against the rules written out in brute.py."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from tracewarp.config import options
from tracewarp.operators import mapping
from tracewarp.operators.dtw import warp, warp_many
from tracewarp.sources import paf

HITS = "read_id long, ref_id long, strand int, t int, q int"


def random_hits(rng, reads=12):
    """Hits on several strands: noise, diagonals, repeats and crossings."""
    out = collections.defaultdict(list)
    for read in range(reads):
        for ref in range(int(rng.integers(1, 4))):
            for strand in (0, 1):
                cells = {(int(t), int(q)) for t, q in rng.integers(0, 80, (int(rng.integers(0, 25)), 2))}
                for _ in range(int(rng.integers(0, 4))):
                    t, q = rng.integers(0, 60, 2)
                    for _ in range(int(rng.integers(1, 9))):
                        cells.add((int(t), int(q)))
                        t, q = t + rng.integers(1, 5), q + rng.integers(1, 5)
                if cells:
                    out[read][:] = out[read]
                    out[read].append(((ref, strand), sorted(cells)))
    return {r: dict(v) for r, v in out.items()}


CASES = [{}, {"best_chains": 5, "least_score": 0.0}, {"prune": False}, {"least_anchors": 1}, {"least_anchors": 4, "least_score": 2.0}, {"e": 3, "skips": 2, "gap": 6, "far": 15, "band": 7}]


@pytest.mark.parametrize("changes", CASES)
def test_chains_follow_the_rule(spark, changes):
    o, rng = options(None, **changes), np.random.default_rng(len(str(changes)))
    worlds = random_hits(rng)
    rows = [(r, ref, strand, t, q) for r, strands in worlds.items() for (ref, strand), cells in strands.items() for t, q in cells]
    got = mapping.chains(spark.createDataFrame(rows, HITS).repartition(3), o).collect()
    want = {(r, c["ref_id"], c["strand"], c["slot"], c["score"], tuple(c["anchors"])) for r, strands in worlds.items() for c in brute.read_chains(strands, o)}
    assert {(x["read_id"], x["ref_id"], x["strand"], x["slot"], x["score"], tuple((a["t"], a["q"]) for a in x["anchors"])) for x in got} == want
    assert len(want) > 5 and all(x["t_start"] == x["anchors"][0]["t"] and x["q_end"] == x["anchors"][-1]["q"] and x["n_anchors"] == len(x["anchors"]) for x in got)


def test_followed_says_what_the_filter_says():
    o = options()
    assert mapping.followed([30.0, 20.0, 15.0, 14.0, 9.0], 30.0, 0.0, o) == [0, 1, 2, 3]
    assert mapping.followed([30.0, 14.0, 13.0], 30.0, 0.0, o) == [0, 1]  # the first one below half is the last one
    assert mapping.followed([30.0, 20.0], 30.0, 50.0, o) == [0] and mapping.followed([30.0], 30.0, 60.0, o) == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 11])
def test_antidiagonal_band_equals_cell_by_cell(radius):
    rng = np.random.default_rng(radius)
    sizes = [(1, 1), (2, 1), (7, 7), (12, 5), (5, 12), (30, 29), (40, 13), (25, 24), (9, 1)]
    a, b = [rng.uniform(-3, 3, n) for n, _ in sizes], [rng.uniform(-3, 3, m) for _, m in sizes]
    want = [brute.banded_cost(x.tolist(), y.tolist(), radius) for x, y in zip(a, b, strict=True)]
    assert warp_many(a, b, radius=radius, antidiagonal=True) == pytest.approx(want)
    assert [warp(x, y, radius=radius, antidiagonal=True) for x, y in zip(a, b, strict=True)] == pytest.approx(want)


def world(rng):
    """References on two strands with a repeated part, and reads cut from them with noise and drift."""
    refs = {(i, s): rng.normal(0, 1.3, 9000 if i == 0 else 300).tolist() for i in range(3) for s in (0, 1)}
    refs[1, 0][100:180] = refs[2, 1][40:120]
    refs[0, 0][4060:4140] = refs[0, 1][10:90]
    reads = {}
    for k, (key, at, n) in enumerate([((1, 0), 20, 60), ((1, 0), 110, 60), ((2, 1), 30, 100), ((0, 0), 4050, 120), ((0, 0), 4000, 300), ((0, 1), 0, 120), ((2, 0), 5, 40)]):
        reads[k] = (np.array(refs[key][at : at + n]) + rng.normal(0, 0.02, n)).tolist()
    reads[90], reads[91], reads[92] = rng.normal(0, 1.3, 80).tolist(), [], [0.5] * 30
    return refs, reads


def frames(spark, refs, reads):
    one = spark.createDataFrame([(i, s, x) for (i, s), x in refs.items()], "ref_id long, strand int, signal array<double>")
    return one, spark.createDataFrame(list(reads.items()), "read_id long, signal array<double>")


def strands_of(spark, refs_df, reads_df, o):
    hits = mapping.anchors(reads_df, mapping.build_index(refs_df, o.e, o.w, o.least_change), o.e, o.w, o.least_change).collect()
    out = collections.defaultdict(lambda: collections.defaultdict(list))
    for h in hits:
        out[h["read_id"]][h["ref_id"], h["strand"]].append((h["t"], h["q"]))
    return out


MODES = [{}, {"least_aligned": None}, {"sparse": False}, {"banded": False, "least_aligned": 2.0}, {"sparse": False, "banded": False}, {"w": 3, "least_aligned": 1.0}, {"bonus": 0.1, "least_aligned": 0.5, "best_chains": 9}, {"least_change": None}]


@pytest.mark.parametrize("changes", MODES)
def test_mapping_follows_the_rules(spark, changes):
    o = options("viral", **changes)
    refs, reads = world(np.random.default_rng(7))
    refs_df, reads_df = frames(spark, refs, reads)
    strands = strands_of(spark, refs_df, reads_df, o)
    got = {r["read_id"]: r for r in mapping.map_reads(reads_df, refs_df, o).collect()}
    assert set(got) == set(reads)
    names = ["ref_id", "strand", "score", "n_anchors", "t_start", "t_end", "q_start", "q_end", "n", "mapq", "confident"]
    mapped = 0
    for i, read in reads.items():
        want = brute.best_place(strands[i], read, refs, o)
        if want is None:
            assert got[i]["ref_id"] is None
            continue
        mapped += 1
        assert [got[i][c] for c in names] == [want[c] for c in names]
        if o.least_aligned is not None:
            assert got[i]["aligned"] == pytest.approx(want["aligned"])
    assert mapped >= 6


def test_bounds_drop_chains(spark):
    """A chain that starts late is given up against a better one, and its read becomes unambiguous; alignment alone wouldn't do that."""
    o = options("viral", least_aligned=0.1, bonus=0.4)
    rng = np.random.default_rng(3)
    read = rng.normal(0, 1.3, 60)
    good, poor = read + rng.normal(0, 0.01, 60), read[10:34] + rng.normal(0, 0.05, 24)
    chains = [{"ref_id": k, "strand": 0, "slot": 0, "score": s, "anchors": [{"t": a - t, "q": a} for a in range(t, t + n, 5)], "ref": ref} for k, (s, t, n, ref) in enumerate([(50.0, 0, 60, good), (20.0, 10, 24, poor)])]
    kept = mapping.scored(chains, read, o)
    alone = mapping.scored(chains[1:], read, o)
    assert [c["ref_id"] for c in kept] == [0] and [c["ref_id"] for c in alone] == [1]


def test_references_in_pieces(spark):
    """Alignment meets references that come in pieces as it meets whole ones."""
    refs, reads = world(np.random.default_rng(7))
    refs_df, reads_df = frames(spark, refs, reads)
    o = options("viral")
    index = mapping.build_index(refs_df, o.e, o.w, o.least_change)
    hits = mapping.anchors(reads_df, index, o.e, o.w, o.least_change)
    pieces = spark.createDataFrame([(i, s, k, x[k : k + 700]) for (i, s), x in refs.items() for k in range(0, len(x), 700)], "ref_id long, strand int, start int, signal array<double>")
    key = lambda df: sorted(map(str, df.drop("anchors").collect()))
    want = key(mapping.best_places(hits, reads_df, refs_df, o))
    assert len(want) >= 6 and key(mapping.best_places(hits, reads_df, pieces, o)) == want
    assert mapping.reference_tiles(pieces).agg(F.max(F.size("part"))).first()[0] <= 700


@pytest.mark.parametrize("sparse", [True, False])
def test_paths_cost_what_they_score(spark, sparse):
    o = options("viral", sparse=sparse, least_aligned=1.0)
    refs, reads = world(np.random.default_rng(7))
    refs_df, reads_df = frames(spark, refs, reads)
    found = mapping.with_path(mapping.map_reads(reads_df, refs_df, o), reads_df, refs_df, o)
    rows = found.collect()
    assert len(rows) == len(reads) and sum(r["path"] is not None for r in rows) >= 5
    for r in rows:
        if not r["confident"]:
            assert r["path"] is None
            continue
        ref, read, cells = refs[r["ref_id"], r["strand"]], reads[r["read_id"]], [(c["t"], c["q"]) for c in r["anchors"]]
        parts = list(zip(cells, cells[1:])) if sparse else [(cells[0], cells[-1])]
        cost = sum(brute.banded_cost(read[q0 : q1 + 1], ref[t0 : t1 + 1]) for (t0, q0), (t1, q1) in parts)
        events = sum(q1 - q0 + 1 for (_, q0), (_, q1) in parts)
        steps = [(p["i"], p["j"], p["d"]) for p in r["path"]]
        assert sum(d for *_, d in steps) == pytest.approx(cost) and r["aligned"] == pytest.approx(events * o.bonus - cost)
        assert all(d == pytest.approx(abs(read[i] - ref[j])) for i, j, d in steps)
        assert steps[0][:2] == (r["q_start"], r["t_start"]) and steps[-1][:2] == (r["q_end"], r["t_end"])
        moves = collections.Counter((y[0] - x[0], y[1] - x[1]) for x, y in zip(steps, steps[1:]))
        assert set(moves) <= {(0, 0), (0, 1), (1, 0), (1, 1)} and moves[0, 0] == len(parts) - 1
    sizes = reads_df.select("read_id", (F.size("signal") * 10).cast("long").alias("samples"), F.greatest(F.size("signal"), F.lit(1)).alias("events"))
    text = paf.parse_paf(paf.paf_lines(paf.paf_rows(found, sizes, refs_df.where("strand = 0").select("ref_id", F.size("signal").alias("len")))))
    back = {int(r["qname"]): r for r in text.collect()}
    for r in rows:
        tags = back[r["read_id"]]["tags"]
        if r["confident"]:
            assert [(p["i"], p["j"]) for p in back[r["read_id"]]["aln"]] == [(p["i"], p["j"]) for p in r["path"]]
            assert float(tags["alns"]) == pytest.approx(r["aligned"], abs=1e-5) and float(tags["s1"]) == pytest.approx(r["score"])
        else:
            assert "aln" not in tags and "alns" not in tags and "anchors" not in tags
        assert r["n"] is not None or (tags["s1"], tags["at"]) == ("0", "0")
