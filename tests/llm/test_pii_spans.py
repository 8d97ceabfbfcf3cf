"""Personal data against versions that look at every pair of spans, and its time on texts of many matches."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tracewarp.llm import pii

from .test_llm import PATTERNS, valid

BASE = {k: re.compile(p) for k, p in PATTERNS.items()}


def brute_base(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(BASE.values()) for m in p.finditer(text) if valid(pii.KINDS[k], m[0])]


def brute_loose(text):
    return {(pii.KINDS.index(kind), m.start(), m.end()) for kind, p, _ in pii.LOOSE for m in re.finditer(p.replace(r"\p{L}", "[^\\W\\d_]"), text)}


def noise(rng, n):
    """Texts of parts that meet, overlap or nearly match."""
    parts = ["+49 30 123456", "+1 (333) 555-7713", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "300.1.1.1", "1,2,3,4", "ann@b.org", "bob (at) c (dot) de", "token: 0123456789abcdef0123", "é😀", "call ", "-", " ", "\n", "x", "7", "mail: "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(3)
    texts = [*noise(rng, 150), None, "", "1 2 3 4 5 6 7 8 9 0 " * 60, "a@b.c " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.candidates(df).collect()}
    assert len(got) == len(texts)
    held_ones = 0
    for i, t in enumerate(texts):
        t = t or ""
        base = brute_base(t)
        assert [(b["kind"], b["start"], b["end"]) for b in got[i]["base"]] == base
        loose = got[i]["loose"]
        assert len(loose) == len({(c["kind"], c["start"], c["end"]) for c in loose})
        assert {(c["kind"], c["start"], c["end"]) for c in loose} == brute_loose(t)
        for c in loose:
            held = any(k == c["kind"] and s < c["end"] and c["start"] < e for k, s, e in base)
            number = valid("card", t[c["start"] : c["end"]])
            cue = re.search(r"(token|secret|passwo?r?d|bearer|auth)[A-Za-z_]{0,8}[\W_]{0,6}$", t[max(0, c["start"] - 24) : c["start"]], re.I)
            label = {"card": number, "secret": bool(cue)}.get(pii.KINDS[c["kind"]], held)
            assert (c["label"], c["free"]) == (int(label), not held and (pii.KINDS[c["kind"]] != "card" or number))
            side = lambda ch: 0 if ch == "" else 1 if ch in " \n" else 3 if ch.isdigit() else 2 if ch.isalpha() else 4
            assert c["before"] == side(t[c["start"] - 1 : c["start"]] if c["start"] else "") and c["after"] == side(t[c["end"] : c["end"] + 1])
            held_ones += held
    assert held_ones > 100


def test_added_spans_equal_all_pairs(spark, monkeypatch):
    """Of the proposals that the model selects, the longest ones that no base span of their kind meets."""
    rng = random.Random(8)
    texts = [*noise(rng, 200), *(f"the token = {rng.getrandbits(160):040x} ok" for _ in range(60)), *(f"pay by visa 4111.1111.1111.1111 or call {i}" for i in range(40))]
    df = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:20])], "doc_id long, text string")
    seen = {}
    select = pii.select_candidates

    def spy(rows, *options):
        out = pii.written(select(rows, *options), "pii-test")
        seen["rows"], seen["chosen"] = rows.where("free").collect(), {tuple(r[f] for f in pii.FEATURES) for r in out.collect()}
        return out

    monkeypatch.setattr(pii, "select_candidates", spy)
    got = pii.find_pii(df).collect()
    assert len(got) == len(texts) + 20
    picked = {}
    for r in seen["rows"]:
        if tuple(r[f] for f in pii.FEATURES) in seen["chosen"]:
            picked.setdefault(r["doc_id"], set()).add((r["kind"], r["start"], r["end"]))
    added = 0
    for r in got:
        own = picked.get(r["doc_id"], set())
        kept = {x for x in own if not any(x != y and x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in own)}
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == sorted({*brute_base(texts[r["doc_id"]]), *kept})
        added += len(kept)
    assert added > 40


def test_redact_equals_plain_replacement(spark):
    rng = random.Random(4)
    texts = [*noise(rng, 150), None, "", "plain", "é" * 100 + "a@b.c", "a@b.c" + "é" * 100, "+49 30 123456 " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    for r in pii.redact(df).collect():
        t, out, at = texts[r["doc_id"]] or "", "", 0
        for s in sorted(spans[r["doc_id"]], key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["start"] >= at:
                out += t[at : s["start"]] + f"[{pii.KINDS[s['kind']].upper()}]"
            at = max(at, s["end"])
        assert (r["text"] or "") == out + t[at:]


def test_query_digests(spark, tmp_path):
    texts = [*noise(random.Random(6), 80), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op10_pii(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        base = brute_base(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in BASE] == [sum(b[0] == k for b in base) for k in range(4)]
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) | {""}


def test_time_grows_with_the_matches(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"+4930{i:09d}" for i in range(n)))], "doc_id long, text string")
        start = time.monotonic()
        assert pii.candidates(df).select(F.size("loose")).first()[0] >= n
        return time.monotonic() - start

    seconds(500)
    few, many = seconds(3000), seconds(24_000)
    assert many < 20 * few  # 64 times where each match is compared with all
