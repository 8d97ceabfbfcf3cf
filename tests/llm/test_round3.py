"""Source divergence, WARC, clustering and the bookkeeping of written tables, against brute force."""

import base64
import collections
import gzip
import hashlib
import re
import threading
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyarrow import fs

from tracewarp.llm import clustering, common, embedding_dedup, mixing, packing, simhash_dedup, source_divergence, warc

SF = "/root/testdata/sf0.001"


def same_as_oracle(spark, query, oracle):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracle).fetch_df()
    got = query(spark, SF).toPandas()[list(want.columns)]
    text = lambda d: sorted(str(["" if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r]) for r in d.astype(object).values.tolist())
    assert text(got) == text(want) and len(got) > 0


def test_new_queries_equal_their_sql(spark):
    same_as_oracle(spark, source_divergence.op11_source_divergence, source_divergence.ORACLE)
    same_as_oracle(spark, warc.op12_warc, warc.ORACLE)
    same_as_oracle(spark, clustering.op13_centroid_clustering, clustering.ORACLE)


# source divergence


def brute_divergence(rows, min_docs, top):
    rows = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    docs, counts = collections.Counter(), collections.Counter()
    for lang, source, words in rows:
        docs.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = sorted(w for (lg, w), n in docs.items() if lg == lang and n >= min_docs)
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=str.encode)

        def shares(of, kept=kept, lang=lang):
            c = {w: sum(counts[lang, s, w] for s in of) for w in kept}
            n = sum(c.values())
            return c, {w: 1 + floor(Fraction(10**9 * (c[w] + 2), n + 2 * len(kept))) for w in kept}

        all_q = shares(sources)[1]
        for s in sources:
            c, p = shares([s])
            pairs = [(sum((p[w] - q[w]) ** 2 // (p[w] + q[w]) for w in kept), o) for o in sources if o != s for q in [shares([o])[1]]]
            terms = [((p[w] - all_q[w]) ** 2 // (p[w] + all_q[w]), w) for w in kept if c[w] and p[w] > all_q[w]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    out.add((lang, s, part, item, value, k))
    return out


def test_divergence(spark):
    rng = np.random.default_rng(1)
    words = ["Alpha", "beta", "GAMMA", "ÄPFEL", "äpfel", "naïve", "x", "日本", "𝔘", "zebra"]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 30)), p=rng.dirichlet(np.ones(10)))) + ";1b_c", ["en", "de", None][i % 3], [f"s{i % 4}", "s0"][i % 5 < 2]) for i in range(90)]
    rows += [(None, None, None), ("", "fr", "only"), ("alone", "it", "a"), ("alone", "it", None), ("word, " * 400_000, "en", "s9"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string")
    for part, top in ((3, 3), (10, 10)):
        got = source_divergence.source_divergence(df.repartition(5), part, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert {tuple(r) for r in got.collect()} == brute_divergence(rows, part, top)
    assert source_divergence.source_divergence(df.limit(0)).count() == 0


def test_shares_are_exact(spark):
    rng = np.random.default_rng(2)
    totals = [int(x) for x in rng.integers(1, 9 * 10**15, 200)] + [3, 1, 9 * 10**15]
    rows = [(int(rng.integers(0, t + 1)), t) for t in totals] + [(5, 5), (0, 7)]
    got = spark.createDataFrame(rows, "n long, t long").select("n", "t", source_divergence.share(source_divergence.F.col("n"), source_divergence.F.col("t")).alias("p")).collect()
    assert len(got) == len(rows) and all(r["p"] == 1 + 10**9 * r["n"] // r["t"] for r in got)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = ("aB" * 40 + " é1cd-e ") * 50
    whole = source_divergence.term_counts(text.encode())
    monkeypatch.setattr(source_divergence, "BLOCK", 7)
    assert source_divergence.term_counts(text.encode()) == whole and sum(whole.values()) == 200
    assert whole[b"ab" * 40] == 50


# WARC


def pages(spark, n=60):
    rows = [(i, f"http://h/{i}?q= ü\r\nx", f"<p>{i % 7}</p>" * (i % 7)) for i in range(n)]
    rows += [(100, None, None), (101, "u", ""), (None, "u", "<p>1</p>"), (None, None, "only without an id"), (3, "again", "<p>3</p>" * 3), (102, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (103, "u", "é" * 300_000), (104, "v", "é" * 300_000)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, digest string")


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    rows, df = pages(spark)
    got = warc.warc_records(df.repartition(3), least, limit=400_000, most=9).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = collections.Counter()
    for i, _, html in rows:
        raw, to = (html or "").encode(), first.get(html or "")
        revisit = len(raw) >= least and to is not None and to != i
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None] += 1
    assert want == collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    payloads = dict.fromkeys(html or "" for _, _, html in rows)
    by_digest = {base64.b32encode(hashlib.sha1(x.encode()).digest()).decode(): x.encode() for x in payloads}
    for r in got:  # every range is a gzip member of its own that holds the record
        system, path = fs.FileSystem.from_uri(r["archive"])
        with system.open_input_file(path) as f:
            f.seek(r["offset"])
            raw = gzip.decompress(f.read(r["length"]))
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        headers, block = warc.parsed(raw)
        assert block.partition(b"\r\n\r\n")[2] == (b"" if r["record_type"] == "revisit" else by_digest[r["payload_digest"]])
    for archive in {r["archive"] for r in got}:  # the members follow each other without gaps, and the whole file is one valid gzip file
        system, path = fs.FileSystem.from_uri(archive)
        with system.open_input_file(path) as f:
            raw = f.read()
        places = sorted((r["offset"], r["length"]) for r in got if r["archive"] == archive)
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) == len(raw)
        assert gzip.decompress(raw).count(b"WARC-Record-ID: ") == len(places)


def test_warc_of_nothing(spark):
    assert warc.warc_records(pages(spark)[1].limit(0)).count() == 0


def test_a_torn_stream_is_an_error():
    import io

    raw = gzip.compress(warc.response(1, "u", b"x" * 5000))
    assert len(list(warc.Stream(io.BytesIO(raw)))) == 1
    with pytest.raises(ValueError):
        list(warc.Stream(io.BytesIO(raw[:-20])))
    with pytest.raises(ValueError):
        list(warc.Stream(io.BytesIO(gzip.compress(warc.response(1, "u", b"x" * 5000)[:-9]))))


# clustering


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [floor(Fraction(float(v)) * 256) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) and abs(v) < 2**19 for v in x)]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centroids = [q for _, q in sorted(kept, key=name)[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    sums = collections.Counter()
    for _, j, d in found:
        sums[j] += d
    return collections.Counter((i, j, d, sums[j], sum(sums.values())) for i, j, d in found), centroids


@pytest.mark.parametrize(("size", "k"), [(1.0, 5), (200_000.0, 4), (1.0, 40)])
def test_clustering(spark, size, k):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, size / 4, 4).round(1 if size == 1 else 3)]) for i in range(60)]
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(120)] + [(7, hot), (None, hot), (None, None)]
    rows += [(2000, None), (2001, []), (2002, hot[:3]), (2003, [*hot[:3], None]), (2004, [*hot[:3], float("nan")]), (2005, [*hot[:3], float("-inf")]), (2006, [*hot[:3], 1e30]), (2007, [-0.0, 0.0, -1e-9, -1 / 256])]
    df = spark.createDataFrame([(*r, 3, "w") for r in rows], "vec_id long, embedding array<double>, cluster int, weight string")
    got, centroids = clustering.clusters(df.repartition(4), k, 3, dims=4)
    want, final = brute_clusters(rows, k, 3, 4)
    assert collections.Counter(tuple(r) for r in got.collect()) == want and centroids.tolist() == final
    assert clustering.clusters(df.limit(0), k, 3, dims=4)[0].count() == 0


# written tables


def test_scopes(spark):
    two, df = spark.newSession(), spark.range(3)
    tables = lambda: spark.sql("SHOW TABLES LIKE 'tracewarp_*'").count()
    others = tables()
    mine, other = common.written(df, "mine"), common.written(two.range(4), "other")
    with common.scratch(spark):
        inner = common.written(df, "inner")
        kept = common.keep(inner, "kept")
        grouped = common.bucketed(df, "grouped", "id")
        assert grouped.count() == 3 and tables() == others + 1
    assert kept.count() == 3 and tables() == others
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        inner.count()
    common.release(spark)
    assert other.count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        mine.count()


def test_calls_at_the_same_time(spark):
    """Calls in threads, each with components of its own, don't remove each other's tables."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 2000, 12)) for _ in range(40)]
    docs = spark.createDataFrame([(i, texts[i % 40]) for i in range(120)], "doc_id long, text string").repartition(2).cache()
    base = rng.normal(size=(30, 16))
    near = spark.createDataFrame([(i, [float(v) for v in base[i % 30] + rng.normal(0, 0.01, 16)]) for i in range(90)], "vec_id long, embedding array<double>").cache()
    found, failed = [], []

    def run(k):
        try:
            if k % 2:
                rows = embedding_dedup.embedding_dedup(near).collect()
                found.append(all(r["component_id"] == r["vec_id"] % 30 for r in rows) and len(rows) == 90)
            else:
                rows = simhash_dedup.simhash_dedup(docs).collect()
                found.append(all(r["component_id"] == r["doc_id"] % 40 for r in rows) and len(rows) == 120)
        except Exception as e:  # noqa: BLE001 - a thread's error has to reach the test
            failed.append(str(e)[:300])

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and found == [True] * 4


# packing


def best_fit_decreasing(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else size) - x)
    return len(gaps)


def test_plans_are_never_longer_than_best_fit():
    rng = np.random.default_rng(12)
    better = 0
    for k in range(30):
        m = int(rng.integers(5, 700))
        skewed = [np.minimum(1024, rng.lognormal(rng.uniform(3, 6.5), rng.uniform(0.3, 1.5), m).astype(int) + 1), rng.integers(1, 1025, m), np.minimum(1024, rng.geometric(1 / rng.uniform(50, 500), m)), rng.choice([1, 7, 340, 342, 511, 683, 1000], m)][k % 4]
        counts = collections.Counter(skewed.tolist())
        patterns = packing.plan(counts)
        used = collections.Counter()
        for times, p in patterns:
            assert times > 0 and 0 < sum(p) <= 1024
            for x in p:
                used[x] += times
        assert used == counts
        plain = best_fit_decreasing(skewed.tolist(), 1024)
        assert sum(t for t, _ in patterns) <= plain == sum(t for t, _ in packing.best_fit(counts))
        better += sum(t for t, _ in patterns) < plain
    assert better >= 1


def test_plans_of_large_counts_are_as_short_as_their_scaled_ones():
    counts = {1: 10**9, 400: 7 * 10**8, 624: 3 * 10**8, 1000: 5, 24: 10**6}
    patterns = packing.plan(counts)
    assert len(patterns) < 100 and sum(t for t, _ in patterns) <= sum(t for t, _ in packing.best_fit(counts))


def test_long_runs_are_found():
    rng = np.random.default_rng(5)
    for k in range(300):
        n, at = int(rng.integers(390, 410)), int(rng.integers(0, 700))
        text = "ab c" * (at // 4) + "x" * (at % 4) + (" x"[k % 2] * n if k % 3 else "\u2003\n" * (n // 2)) + "d\te " * int(rng.integers(0, 99))
        assert packing.has_long_run(text) == bool(packing._LONG.search(text))
    assert not packing.has_long_run("") and packing.has_long_run("é" * 400)


# mixing


@pytest.mark.parametrize(("most_sources", "heavy"), [(4, 30_000), (1, 900)])
def test_small_sources_share_a_queue(spark, most_sources, heavy):
    """Sources that share a queue run out one by one; by bisection of the fluid schedule, at every slot the queue and the others are less than a block off."""
    rng = np.random.default_rng(most_sources)
    sizes = {f"s{k:02}": int(n) for k, n in enumerate([heavy, 700, 500, *rng.integers(1, 400, 37)])}
    names = sorted(sizes, key=lambda k: (-sizes[k], k))
    size = 8
    sizes[names[-1]] += -sum(sizes[k] for k in names[most_sources:]) % size  # the queue ends with a whole block, as the fluid schedule does
    docs = spark.createDataFrame(pd.DataFrame({"source": np.repeat(list(sizes), list(sizes.values()))}).assign(doc_id=range(sum(sizes.values()))))
    rows = mixing.mix(docs, block=size, most_sources=most_sources).toPandas()
    assert sorted(rows["doc_id"]) == list(range(len(rows))) and rows["place"].is_unique
    names = sorted(sizes, key=lambda k: (-sizes[k], k))
    alone = np.array([k < most_sources for k in range(len(names))])
    n = np.array([sizes[k] / size for k in names])
    ends = np.where(alone, np.ceil(n), n)
    w = np.sqrt(n)
    had = pd.crosstab(rows["slot"], rows["source"])[names].cumsum().to_numpy() / size
    slots = rows["slot"].max() + 1
    assert len(had) == slots
    off, shared_off, own_off = 0.0, 0.0, 0.0
    for t in range(1, slots):
        low, high = 0.0, (ends / w).max()
        for _ in range(60):
            v = (low + high) / 2
            low, high = (v, high) if np.minimum(w * v, ends).sum() < t else (low, v)
        fluid = np.minimum(w * v, ends)
        gap = np.abs(had[t - 1] - fluid)
        full = np.where(np.ceil(n) == np.ceil(had[t - 1]), np.ceil(n), had[t - 1])  # a last, short block is a block
        off = max(off, np.abs(full - fluid)[alone].max())
        shared_off = max(shared_off, abs(had[t - 1][~alone].sum() - fluid[~alone].sum()))
        own_off = max(own_off, gap[~alone].max())
    assert off < 1 and shared_off < 1 and own_off < 1.25, (off, shared_off, own_off)
