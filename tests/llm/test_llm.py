import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from tracewarp.llm import embedding_dedup, hmm_scoring, license_scan, line_dedup, media_columns, minhash_dedup, mixing, packing, pii, quality_classifier, simhash_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [(i, f"Shared line\n  SHARED LINE \nown {i} words are here {i * 7}", "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(20, None, "en", "s0", None), (21, "", None, None, 0), (22, LONG, "de", "s1", 9), (23, "\n\n", "en", "s1", 2), (None, "no id here at all", "en", "s2", 3)]
    rows += [(0, rows[0][1], "en", "s0", 1), (30, "call +1 (017) 555-7713 now or mail a@b.example.com", "en", "s0", 5)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], COLUMNS + ", n string, k int")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def key(line):
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower()


def test_lines(docs, empty):
    out = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(docs, batches=3, fanout=2).collect()}
    seen = collections.defaultdict(set)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    for i, t in rows:
        for x in t.split("\n"):
            seen[key(x)].add(i)
    for i, t in rows:
        kept = [x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10]
        n = len(t.split("\n"))
        assert (i, n, n - len(kept), "\n".join(kept)) in out
    assert line_dedup.line_dedup(empty).count() == 0


def test_hmm(docs, empty):
    rows = hmm_scoring.score_documents(docs, rounds=2, heads=8, tails=4).collect()
    assert len(rows) == docs.count()
    counts = collections.Counter()
    for r in docs.collect():
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update([*(r["text"] or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        tokens = [*(texts[r["doc_id"]] or "").encode().lower().split(), b""]
        assert r["train_tokens"] == n and r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert r["score"] < 0
    assert hmm_scoring.score_documents(empty).count() == 0


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    model = hmm_scoring.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), rng.dirichlet(np.ones(5), 2).T)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 6)]
    for who, g, owner, alive, first in hmm_scoring._slabs(seqs):
        _, scale = hmm_scoring.forward(model, g, alive, first)
        got = np.bincount(owner, np.log(scale))
        for i, at in enumerate(who):
            s = seqs[at]
            total = sum(model.start[p[0]] * model.emit[s[0], p[0]] * math.prod(model.move[p[k - 1], p[k]] * model.emit[s[k], p[k]] for k in range(1, len(s))) for p in np.ndindex(*(2,) * len(s)))
            assert got[i] == pytest.approx(math.log(total))
        start, move, emit, _ = hmm_scoring.expected(model, g, alive, first)
        assert start.sum() == pytest.approx(4) and move.sum() == pytest.approx(13) and emit.sum() == pytest.approx(17)


def test_packing(docs, empty):
    rows = packing.pack(docs, packing.default_tokenizer(), size=64).collect()
    encode = packing.Encoder(packing.default_tokenizer())
    want = collections.Counter()
    for r in docs.collect():
        ids = [*encode.slow.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 64 or 64
        for k, e in enumerate(range(cut, len(ids) + 1, 64)):
            s = 0 if k == 0 else e - 64
            want[r["doc_id"], k, s, e - s, np.array(ids[s:e], "<u4").tobytes()] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(x for _, x in places[:i]) for i in range(len(places))] and sum(x for _, x in places) <= 64
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(5)
    lengths, n = np.unique(np.minimum(1024, rng.lognormal(5.5, 1.2, 5000).astype(int) + 1), return_counts=True)
    patterns = packing.plan(dict(zip(lengths.tolist(), n.tolist(), strict=True)))
    used = collections.Counter()
    for times, p in patterns:
        assert sum(p) <= 1024
        for x in p:
            used[x] += times
    assert used == collections.Counter(dict(zip(lengths.tolist(), n.tolist(), strict=True)))
    assert sum(t for t, _ in patterns) <= 1.002 * math.ceil((lengths * n).sum() / 1024) + 1


def test_packing_fills_up_with_short_pieces():
    for lengths, good in ((range(1, 100), 5), (range(1, 40), 1), (range(30, 61), 2)):
        patterns = packing.plan({x: 1 for x in lengths})
        assert sorted(x for times, used in patterns for x in used * times) == list(lengths)
        assert sum(times for times, _ in patterns) == good


def fewest(lengths, size):
    """The least number of sequences, by trying every place for each piece."""
    best = len(lengths)

    def put(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(lengths):
            best = len(gaps)
            return
        for g in {g for g in gaps if g >= lengths[k]}:
            rest = list(gaps)
            rest.remove(g)
            put(k + 1, [*rest, g - lengths[k]])
        put(k + 1, [*gaps, size - lengths[k]])

    put(0, [])
    return best


def test_plan_against_the_optimum():
    rng = np.random.default_rng(9)
    over = 0
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 9)).tolist(), reverse=True)
        got = sum(times for times, _ in packing.plan(dict(collections.Counter(lengths)), 20))
        over += got - fewest(lengths, 20)
    assert 0 <= over <= 1


def test_packing_follows_the_schedule(spark, tmp_path):
    """Sources of equal weight take turns in the mixed files; every prefix of the sequences has them in equal shares."""
    import random

    import corpus_pipeline

    random.seed(3)
    rows = [(i, " ".join(random.choice(["river", "stone", "cloud"]) for _ in range(random.choice([80, 150, 300, 600]))), "en", "a" if i < 400 else "b", 1) for i in range(800)]
    df = spark.createDataFrame(rows, COLUMNS)
    mixing.mixed_documents(df).write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == collections.Counter(range(800))
    ids = {r["sequence_id"] for r in got}
    assert ids == set(range(len(ids)))
    slot = {r["doc_id"]: r["place"] for r in mixing.mix(df).collect()}
    firsts = [min(slot[r["doc_id"]] for r in got if r["sequence_id"] == k) for k in range(len(ids))]
    assert firsts == sorted(firsts)
    for k in range(len(ids) // 5, len(ids), 10):
        part = collections.Counter("a" if r["doc_id"] < 400 else "b" for r in got if r["sequence_id"] < k)
        assert abs(part["a"] / part.total() - 0.5) < 0.08


def test_encoders_agree():
    encode = packing.Encoder(packing.default_tokenizer())
    for t in ["", "a  b\n\n c", "naïve café ½ 漢字 😀 👩‍👩‍👧", "x" * 5000, " " * 3000 + "y", "<|endoftext|> a", "  z", "'S 's it's"]:
        assert encode(t) == encode.slow.encode(t, add_special_tokens=False).ids


def brute_components(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, empty):
    import random

    random.seed(1)
    words = [f"w{i}" for i in range(300)]
    base = [[random.choice(words) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(240):
        t = list(base[i % 6])
        for _ in range(i // 60):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash_dedup.simhash_dedup(df).collect()}
    fps = {i: f for i, (f, _) in got.items()}
    for i, t in rows[:20]:
        w = t.split()
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(len(w) - 2)]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
        assert fps[i] & (1 << 64) - 1 == want
    want = brute_components(list(fps), lambda a, b: ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2)
    assert {i: c for i, (_, c) in got.items()} == want
    reps = spark.createDataFrame([(f, min(i for i in fps if fps[i] == f)) for f in set(fps.values())], "fp long, rep long")
    for crowd in (0, 48):
        pairs = simhash_dedup.near_links(reps, crowd).collect()
        assert all(((fps[p["a"]] ^ fps[p["b"]]) & (1 << 64) - 1).bit_count() <= 2 for p in pairs)
    assert simhash_dedup.simhash_dedup(docs).count() == docs.count()
    assert simhash_dedup.simhash_dedup(empty).count() == 0 and simhash_dedup.one_of_each(docs).columns == docs.columns


def test_near_copies(spark, docs, empty):
    """A pair's SimHashes differ in up to 11 bits at similarity 0.8; every pair must be found, in small and in crowded bands."""
    import random

    import corpus_pipeline

    random.seed(8)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for copies, changes in [(2, 4)] * 40 + [(60, 2), (60, 5), (40, 12)]:
        base = [random.choice(words) for _ in range(200)]
        for c in range(copies):
            t = list(base)
            for _ in range(changes if c else 0):
                t[random.randrange(len(t))] = random.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, "too short"), (n + 2, "Too  SHORT"), (n + 3, None), (n + 4, "")]
    grams = {}
    for i, t in rows:
        w = (t or "").lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    alike = lambda a, b: grams[a] == grams[b] or len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    want = set(brute_components([i for i, _ in rows], alike).values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 60 < len(want) < 150
    for options in ({"tile": 8},):
        assert {r["doc_id"] for r in simhash_dedup.one_of_each(df, **options).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want
    assert minhash_dedup.one_of_each(empty).count() == 0 and minhash_dedup.one_of_each(docs).columns == docs.columns


def test_media(docs, empty):
    rows = media_columns.media_columns(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r["width"] == 64 and r["height"] == len(pay) // 64
    assert media_columns.media_columns(empty).count() == 0


def test_embeddings(spark):
    """Every link and component of loose, crowded and copied vectors against brute force, for several ways to count."""
    rng = np.random.default_rng(2)
    center = rng.normal(size=(5, 16))
    x = np.concatenate([center[i % 5] + rng.normal(size=16) * 0.15 for i in range(200)] + [rng.normal(size=16) for _ in range(60)]).reshape(-1, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[0].tolist()), (301, None), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, []), (305, [1.0, None]), (5, x[5].tolist()), (306, rng.normal(size=3000).tolist())]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rep string, component_id int")
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i <= 300]
    near = np.array([[b is not a and a[1] @ b[1] >= 0.9 for b in good] for a in good])
    links = collections.Counter((i, int(n)) for (i, _), n in zip(good, near.sum(1), strict=True))
    reach = near | np.eye(len(good), dtype=bool)
    while ((more := reach @ reach) != reach).any():
        reach = more
    want = {i: min(good[m][0] for m in np.flatnonzero(reach[k])) for k, (i, _) in enumerate(good)}
    for options in ({"window": 64}, {"window": 64, "few": 5, "tile": 16}):
        got = embedding_dedup.embedding_dedup(df, recall=0.999, **options).collect()
        assert collections.Counter((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] <= 300) == links
        assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] <= 300} == want
        assert all(r["n_links"] == 0 and r["kept"] for r in got if r["vec_id"] > 300)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_in_a_dense_group(spark):
    """Vectors at cosine 0.8 of each other, of which pairs at 0.91 must be found though few bits part the group."""
    rng = np.random.default_rng(5)
    center = rng.normal(size=64)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(center) * 0.8**0.5 + unit(rng.normal(size=(1500, 64))) * 0.2**0.5)
    y = unit(x[:300] + unit(rng.normal(size=(300, 64))) * 0.42)
    v = np.concatenate([x, y])
    df = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(v)], "rep long, vec array<double>, copies long")
    links, _ = embedding_dedup.near_links(df, 0.9, window=32)
    found = {r["rep"]: r["n"] for r in links.collect()}
    true = (v @ v.T >= 0.9).sum(1) - 1
    assert true.sum() >= 200 and all(n <= true[i] for i, n in found.items()) and sum(found.values()) >= 0.97 * true.sum()


def test_schedule_follows_exact_shares():
    """At every slot each source has had its fluid share, by exact fractions, within less than a block; all blocks come once and in order."""
    from fractions import Fraction

    rng = np.random.default_rng(4)
    cases = [([0.9997, 0.0003], [3000, 40]), ([1 / (i + 1) ** 2 for i in range(50)], rng.integers(0, 60, 50).tolist()), ([1.0] * 4, [3] * 4), ([2.5], [7])]
    for weights, blocks in cases:
        w, had = mixing.whole_weights(weights), [0] * len(weights)
        ends = sorted((Fraction(b, x), b, x) for b, x in zip(blocks, w, strict=True) if b)
        for t, (i, j) in enumerate(mixing.schedule(w, blocks), 1):
            assert j == had[i]
            had[i] += 1
            gone, active = 0, sum(x for _, _, x in ends)
            for end, b, x in ends:
                if gone + end * active >= t:
                    break
                gone, active = gone + b, active - x
            v = Fraction(t - gone, active)
            assert all(abs(min(x * v, b) - n) < 1 for x, b, n in zip(w, blocks, had, strict=True))
        assert had == blocks
    total = mixing.whole_weights([0.9997, 0.0003])
    assert abs(total[1] / sum(total) - 0.0003) < 1e-12
    with pytest.raises(ValueError):
        mixing.whole_weights([1.0, 0.0])


def test_mixing(spark, docs, empty):
    n = docs.count()
    for options in ({"block": 2}, {"block": 2, "most_sources": 2}, {"most_slots": 4}, {"weights": {"s0": 3.0, "s1": 1.0}}):
        rows = mixing.mix(docs, **options).collect()
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in docs.collect())
        assert len({r["place"] for r in rows}) == n
    rows = mixing.mix(docs, block=1).collect()
    counts = collections.Counter(r["source"] for r in docs.collect())
    names = sorted(counts, key=lambda k: (-(counts[k] ** 0.5), k or ""))
    want = mixing.schedule(mixing.whole_weights([counts[k] ** 0.5 for k in names]), [counts[k] for k in names])
    assert sorted((r["slot"], r["source"], r["block"]) for r in rows) == [(t, names[i], j) for t, (i, j) in enumerate(want)]
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() == n


def test_clashing_names(spark):
    """Columns named like the operators' own ones come through unchanged."""
    names = ["drop", "lines", "id", "hash", "tx", "whole", "key", "slot", "place", "nth", "tie", "spans", "more", "a.b", "_tx", "_id", "_drop", "node", "_h"]
    rows = [(i, f"mail a{i}@b.example.com\nsame line", "en", f"s{i % 2}", 1, *(f"{c}{i}" for c in names)) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for out in (line_dedup.line_dedup(df), mixing.mixed_documents(df), pii.redact(df), simhash_dedup.one_of_each(df)):
        assert out.columns[: len(df.columns)] == df.columns
        got = {r["doc_id"]: tuple(r[c] for c in names) for r in out.collect()}
        assert len(got) == 12 and all(got[r[0]] == r[5:] for r in rows)
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    assert quality_classifier.kept_documents(df, labels).columns == df.columns


def test_quality(spark, docs, empty):
    import random

    random.seed(4)
    word = lambda: "".join(random.choice(["the", "ing", "er", "and", "on"]) for _ in range(random.randint(1, 3)))
    good = [(i, " ".join(word() for _ in range(80)) + ".", "en") for i in range(120)]
    junk = [(200 + i, " ".join(random.choice("%$#&|") * 3 + str(random.random()) for _ in range(40)), "en") for i in range(20)]
    df = spark.createDataFrame([*good, *junk, (300, None, None), (301, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(None, 1), (200, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(df, labels, chunk_bytes=5000).collect()}
    assert all(got[i] for i in range(120)) and not any(got[200 + i] for i in range(20)) and not got[300] and not got[301]
    assert quality_classifier.kept_documents(df, labels).count() == 120
    assert quality_classifier.classify(empty, labels).count() == 0 and quality_classifier.classify(docs, labels.limit(0)).count() == docs.count()


def test_toxic_text_is_not_trusted(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["_good"] for r in quality_classifier.trusted_ids(labels).collect()] == [1]
    df = spark.createDataFrame([(i, f"plain words {i}", "en") for i in (1, 2, 3, 4)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality_classifier.perplexities(df, labels).where("role != 0").collect()} == {1}


def test_thresholds_cover_all_trusted_rows(spark):
    """Of 100 trusted rows 20 are sampled for the fit; the other 80 are held. Languages with few or no labels keep their clean text."""
    import random

    random.seed(6)
    text = lambda parts: " ".join("".join(random.choice(parts) for _ in range(random.randint(1, 3))) for _ in range(80))
    rows = [(i, text(["the", "ing", "er", "and", "on"]), "en") for i in range(100)]
    rows += [(200 + i, text(["zu", "qua", "xi", "ojo", "wyk"]), "xx") for i in range(50)]
    rows += [(300 + i, text(["bam", "ful", "gov", "dep", "jik"]), "yy") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(100), 200, 201]], "doc_id long, quality int, toxic int")
    roles = collections.Counter(r["role"] for r in quality_classifier.perplexities(df, labels, max_trusted=20).where("doc_id < 100").collect())
    assert roles[0] == 0 and roles[quality_classifier.TRAIN] <= 20 and roles[quality_classifier.HELD] >= 80
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(df, labels, max_trusted=20).collect()}
    assert all(got[i] for i in range(100))
    assert sum(got[200 + i] for i in range(50)) >= 45 and sum(got[300 + i] for i in range(50)) >= 45


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([("abracadabra",), ("banana bandana",)], "text string")
    tables = quality_classifier._counts(df, 3)
    for context in (b"br", b"an", b"zz", b"\0\0"):
        keys = [(int.from_bytes(context + bytes([b])),) for b in range(256)]
        p = quality_classifier.probabilities(spark.createDataFrame(keys, "key long"), tables)
        assert sum(r["p"] for r in p.collect()) == pytest.approx(1)


def test_licenses(spark, docs, empty):
    t = license_scan.TEMPLATES
    rows = [(i, f"{'filler words go here ' * (i + 1)}{x} and {'more text ' * 9}") for i, x in enumerate(t.values())]
    rows += [(50, LONG + " " + t["MIT-text"].replace("Software", "SOFTWARE", 1)), (51, "Licensed under nothing in particular by anyone"), (52, "short one")]
    got = {(r["doc_id"], r["template"]): r["containment"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(t):
        assert got[i, name] == 1
    assert got[50, "MIT-text"] >= 0.8 and not any(d in (51, 52) for d, _ in got)
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0


def test_licenses_against_all_windows(spark):
    """Changed and cut templates in random texts: every window that contains enough of a template, by brute force."""
    import random

    random.seed(2)
    vocabulary = [f"w{i}" for i in range(800)]
    known = {f"t{k}": " ".join(random.choice(vocabulary) for _ in range(random.choice([6, 30, 80, 200]))) for k in range(20)}
    rows = []
    for d in range(80):
        t = [random.choice(vocabulary) for _ in range(random.randint(0, 400))]
        w = known[f"t{d % 20}"].split()
        for _ in range(int(len(w) * random.choice([0, 0.01, 0.03]))):
            w[random.randrange(len(w))] = "changed"
        at = random.randint(0, len(t))
        t[at:at] = w[: int(len(w) * random.choice([1, 0.9]))]
        rows.append((d, " ".join(t)))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for name, x in known.items():
        s = set(grams(x.split()))
        width, step = license_scan.shape(next(n for n in license_scan.classes(200) if n >= len(x.split())))
        for d, t in rows:
            g = grams(t.split())
            found = [(len(s & set(g[k : k + width - 4])) / len(s), -k) for k in range(0, len(g), step)]
            found = [x for x in found if x[0] >= 0.8]
            if found:
                want[d, name] = (max(found)[0], -max(found)[1], len(found))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert len(want) > 40 and {(r["doc_id"], r["template"]): (r["containment"], r["first_word"], r["windows"]) for r in got} == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(spark, docs, empty):
    tricky = ["a@b.c_d@e.f.@x.y", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "é😀 +1 (017) 555-7713é +49 30 123456", "++12345678901 +1", "4" * 4000 + "." * 50, "a" * 20000 + "@", LONG]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(tricky, 100)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    for r in df.collect():
        t = r["text"] or ""
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in got[r["doc_id"]]["base"]] == want, t[:80]
        assert {(s["kind"], s["start"], s["end"]) for s in got[r["doc_id"]]["base"]} <= {(s["kind"], s["start"], s["end"]) for s in got[r["doc_id"]]["spans"]}
    assert pii.find_pii(empty).count() == 0
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[30] == "call [PHONE] now or mail [EMAIL]"


def test_pii_adds_spans(spark):
    rows = [(i, f"please call +1 ({100 + i}) 555-{7000 + i} today, order {1000000 + i * 7919}") for i in range(200)]
    rows += [(900, "please call 1 (333) 555-7713 today"), (901, "nothing here, order 1234567")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in got[900]["spans"]] == [(12, 28)] and not got[900]["base"] and not got[901]["spans"]


def test_pii_finds_secrets_and_joined_cards(spark):
    import random

    random.seed(5)
    mark = lambda: "".join(random.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'the token = "{mark()}" is {"internationalization" if i % 2 else "wordswithoutanydigits"} no{i}') for i in range(150)]
    rows += [(200 + i, f"pay 4111111111111111 by visa, ticket {random.randrange(10**12, 10**13)}") for i in range(150)]
    secret = mark()
    rows += [(900, f'value "{secret}" here'), (901, "pay 4111111111111111 4111111111111111 now"), (902, "plain words only")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {i: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for i, r in got.items()}
    assert all(("secret", 13, 53) in spans[i] for i in range(150))  # digits in a mark may be a card number as well
    assert spans[900] == [("secret", 7, 47)] and spans[902] == []
    assert got[901]["base"] == [] and spans[901] in ([], [("card", 4, 20), ("card", 21, 37)])


def test_pipeline(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
