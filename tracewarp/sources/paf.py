"""Mappings and anchors as text: twelve columns with tags, and one line of anchors for each read and reference strand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples a second and bases a second of the sequencer.
RATE, SPEED = 4000.0, 450.0

NUMBERS = ["qlen", "qstart", "qend", "tlen", "tstart", "tend", "matches", "block", "mapq"]


def position_scale(samples: Column, events: Column, rate: float = RATE, speed: float = SPEED) -> Column:
    """Bases an event, from the samples that the events came from."""
    return samples / events / (rate / speed)


def listed(cells: Column, *fields: str) -> Column:
    """An array of structs as (a,b)(c,d)."""
    return F.array_join(F.transform(cells, lambda x: F.concat(F.lit("("), F.concat_ws(",", *(x[f].cast("string") for f in fields)), F.lit(")"))), "")


def paf_rows(found: DataFrame, reads: DataFrame, refs: DataFrame, chains: bool = True) -> DataFrame:
    """One row for each read of map_reads(): the twelve columns and ``tags`` (name:type:value, tab-separated).

    reads has (read_id, samples, events), refs (ref_id, len). Only a confident mapping has places; for the others the columns from
    the third to the eleventh are null and the quality is 0. Places on the reverse strand count from the reference's start, and
    the mean gaps divide by the number of anchors. s1, s2 and sm are chaining scores, whatever judged the chains, and "0" without any.
    Columns chunks and ms of found become tags if they are there. A confident mapping's path, with its score, and its anchors
    (with ``chains``) are tags too.
    """
    rows = found.join(reads.select("read_id", "samples", F.col("events").alias("n_events")), "read_id").join(refs.select("ref_id", "len"), "ref_id", "left")
    scale = position_scale(F.col("samples"), F.col("n_events"))
    sure = F.coalesce(F.col("confident"), F.lit(False))
    whole = lambda c: (scale * c).cast("long")
    size = (F.col("t_end") - F.col("t_start") + 1).cast("long")
    start = F.when(F.col("strand") == 1, F.col("len") + 1 - F.col("t_end")).otherwise(F.col("t_start")).cast("long")
    on = lambda c: F.when(sure, c)
    has = lambda c, other: F.col(c) if c in found.columns else F.lit(other)
    number = lambda c: F.format_string("%.6f", F.coalesce(c.cast("double"), F.lit(0.0)))
    score = lambda c: F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, number(c)).otherwise("0")
    count = F.coalesce(F.col("n_anchors"), F.lit(0))
    gap = lambda side: (F.col(f"{side}_end") - F.col(f"{side}_start")) / F.col("n_anchors")
    tags = [
        ("mt:f:", number(has("ms", 0.0))), ("ci:i:", has("chunks", 1).cast("string")), ("sl:i:", F.col("samples").cast("string")), ("cm:i:", count.cast("string")),
        ("nc:i:", F.coalesce(F.col("n"), F.lit(0)).cast("string")), ("s1:f:", score(F.col("score"))), ("s2:f:", score(F.col("score_s2"))), ("sm:f:", score(F.col("score_mean"))),
        ("at:f:", score(gap("t"))), ("aq:f:", score(gap("q"))),
    ]
    if "path" in found.columns:
        tags += [("alns:f:", on(number(F.col("aligned")))), ("aln:s:", on(listed(F.col("path"), "i", "j", "d")))]
    if chains and "anchors" in found.columns:
        tags.append(("anchors:s:", on(listed(F.reverse("anchors"), "q", "t"))))
    return rows.select(
        F.col("read_id").cast("string").alias("qname"), F.when(sure, whole(F.col("q_end"))).otherwise(whole(F.col("n_events"))).alias("qlen"),
        on(whole(F.col("q_start"))).alias("qstart"), on(whole(F.col("q_end"))).alias("qend"), on(F.when(F.col("strand") == 1, "-").otherwise("+")).alias("strand"),
        on(F.col("ref_id").cast("string")).alias("tname"), on(F.col("len").cast("long")).alias("tlen"), on(start).alias("tstart"), on(start + size).alias("tend"),
        on(whole(F.col("q_end")) - whole(F.col("q_start")) - 1).alias("matches"), on(size).alias("block"), F.when(sure, F.col("mapq")).otherwise(0).cast("long").alias("mapq"),
        F.concat_ws("\t", *(F.concat(F.lit(name), value) for name, value in tags)).alias("tags"),
    )


def paf_lines(rows: DataFrame) -> DataFrame:
    """(value): a line for each row of paf_rows(), '*' for nulls."""
    order = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "block", "mapq"]
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in order), "tags").alias("value"))


def _cells(text: Column, kind: str, *fields: str) -> Column:
    """The structs of a text like (a,b)(c,d); null for null."""
    parts = F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1))
    types = kind.split()
    return F.transform(parts, lambda p: F.struct(*(F.get(F.split(p, ","), F.lit(i)).try_cast(t).alias(f) for i, (f, t) in enumerate(zip(fields, types, strict=True)))))


def parse_paf(lines: DataFrame) -> DataFrame:
    """Rows of lines with twelve columns and tags: nulls for '*', tags as a map, and the tags aln and anchors as arrays (null without them).

    Lines with fewer columns are left out; of a repeated tag the last value stays.
    """
    p = F.split("value", "\t")
    at = lambda i: F.when(F.get(p, F.lit(i)) != "*", F.get(p, F.lit(i)))
    found = F.filter(F.slice(p, 13, F.greatest(F.size(p) - 12, F.lit(0))), lambda x: x.rlike("^[^:]+:[^:]+:"))
    pairs = F.transform(found, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("k"), F.regexp_replace(x, "^[^:]+:[^:]+:", "").alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    places = dict(zip(NUMBERS, (1, 2, 3, 6, 7, 8, 9, 10, 11), strict=True))
    rows = lines.where(F.size(p) >= 12).select(
        F.get(p, F.lit(0)).alias("qname"), at(4).alias("strand"), at(5).alias("tname"), *(at(i).try_cast("long").alias(c) for c, i in places.items()), F.map_from_entries(last).alias("tags")
    )
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return rows.withColumns({"aln": _cells(tag("aln"), "int int double", "i", "j", "d"), "anchors": _cells(tag("anchors"), "int int", "q", "t")})


def anchor_lines(hits: DataFrame) -> DataFrame:
    """(value): hits (read_id, ref_id, strand, t, q) as log lines of anchors. A line holds the hits of at most 1,000 target
    places, so no line grows with a repeat."""
    part = F.floor(F.col("t") / 1000)
    lists = hits.groupBy("read_id", "ref_id", "strand", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("t", "q"))).alias("a"))
    return lists.select(F.concat(F.lit("readname="), F.col("read_id").cast("string"), F.lit(" refname="), F.col("ref_id").cast("string"), F.lit(" strand="), F.col("strand").cast("string"), F.lit(" anchors="), listed(F.col("a"), "q", "t")).alias("value"))


def parse_anchor_lines(lines: DataFrame) -> DataFrame:
    """(qname, tname, strand, q, t): a row for each anchor of every log line; other lines are left out."""
    form = r"^readname=(\S+)\srefname=(\S+)\sstrand=(\d)\sanchors=((?:\(\d+,\d+\))+)"
    get = lambda i: F.regexp_extract("value", form, i)
    rows = lines.where(F.col("value").rlike(form)).select(get(1).alias("qname"), get(2).alias("tname"), F.when(get(3) == "1", "-").otherwise("+").alias("strand"), F.explode(_cells(get(4), "int int", "q", "t")).alias("c"))
    return rows.select("qname", "tname", "strand", "c.q", "c.t")


def anchors_of_mappings(anchors: DataFrame, paf: DataFrame) -> DataFrame:
    """The anchors whose read was mapped to their reference and strand, each with whether its chain holds it."""
    wanted = paf.where("tname is not null").select("qname", "tname", "strand", F.col("anchors").alias("chain")).dropDuplicates(["qname", "tname", "strand"])
    rows = anchors.join(wanted, ["qname", "tname", "strand"])
    return rows.withColumn("chained", F.exists(F.coalesce("chain", F.array().cast("array<struct<q:int,t:int>>")), lambda x: (x["q"] == F.col("q")) & (x["t"] == F.col("t")))).drop("chain")


def read_times(rows: DataFrame, verdict: str = "rf") -> DataFrame:
    """One row of means over parse_paf() rows that carry a verdict tag (tp, fp, fn, tn or na): milliseconds a chunk and their median over all
    that have scores, milliseconds over those that aren't na, and bases and chunks of mapped, unmapped and all reads. What has no reads
    is infinite. Rows of the short form, without scores, have milliseconds only."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    long = tag("cm").isNotNull()
    mt, chunks, kind = tag("mt").try_cast("double"), tag("ci").try_cast("long"), tag(verdict)
    mapped = F.col("tname").isNotNull()
    some = rows.where(kind.isNotNull())
    inf = F.lit(float("inf"))
    mean = lambda when, x: F.coalesce(F.avg(F.when(when, x)), inf)
    out = [mean(long, mt / chunks).alias("mean_chunk_time"), F.coalesce(F.median(F.when(long, mt / chunks)), inf).alias("median_chunk_time")]
    out += [mean(kind != "na", mt).alias("mean_time"), F.coalesce(F.median(F.when(kind != "na", mt)), inf).alias("median_time")]
    for name, when in (("mapped", long & mapped), ("unmapped", long & ~mapped), ("all", long)):
        out += [mean(when, F.col("qlen")).alias(f"bases_{name}"), mean(when, chunks).alias(f"chunks_{name}")]
    return some.agg(*out)
