"""Sequences with exactly n substitutions, insertions or deletions, however long they are and however they are cut.

Places are the n smallest hashes of (sequence, place, seed), by bits of the hash and then the hash itself. A piece offers its own n smallest
ones; these are counted by bin: all bins below the one in which the n-th lies are taken whole, and that one up to it. Edits then go to
the pieces they are in, and a running sum over the pieces moves what follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE, BINS = 4096, 4096


def pieces(refs: DataFrame, size: int = PIECE) -> DataFrame:
    """(ref_id, at, seq): refs (ref_id, seq) in consecutive pieces of at most ``size`` letters."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.char_length("seq").cast("long") - 1, F.lit(size).cast("long")))
    return refs.where(F.char_length("seq") > 0).select("ref_id", starts.alias("at"), "seq").select("ref_id", "at", F.substring("seq", F.col("at") + 1, F.lit(size)).alias("seq"))


def sampled_places(parts: DataFrame, n: int, seed: int = 1, bins: int = BINS) -> DataFrame:
    """(ref_id, at, i, h): n places of every sequence, or all of a shorter one; i counts within the piece at ``at``. No piece has more than n of
    them, so only its own n smallest leave it."""
    hashes = F.transform(F.sequence(F.lit(0), F.char_length("seq") - 1), lambda i: F.xxhash64("ref_id", F.col("at") + i, F.lit(seed)))
    bin_of = lambda h: F.pmod(F.shiftrightunsigned(h, 32), F.lit(bins))
    least = F.slice(F.sort_array(F.transform(hashes, lambda h, i: F.struct(bin_of(h).alias("bin"), h.alias("h"), i.alias("i")))), 1, n)
    places = parts.select("ref_id", "at", F.explode(least).alias("x"))
    held = places.groupBy("ref_id", "x.bin").agg(F.sort_array(F.collect_list(F.struct("x.h", "at", "x.i"))).alias("p"))
    before = F.coalesce(F.sum(F.size("p")).over(Window.partitionBy("ref_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = held.withColumn("before", before).where(F.col("before") < n)
    found = wanted.select("ref_id", F.explode(F.slice("p", F.lit(1), (n - F.col("before")).cast("int"))).alias("x"))
    return found.select("ref_id", "x.at", "x.i", "x.h")


def _letter(h: Column) -> Column:
    return F.substring(F.lit("ACGT"), F.pmod(h, F.lit(4)).cast("int") + 1, F.lit(1))


def _edited(letter: Column, h: Column, kind: str) -> Column:
    if kind == "substitute":
        place = F.pmod(F.instr(F.lit("ACGT"), F.upper(letter)) - 1 + F.pmod(h, F.lit(3)) + 1, F.lit(4))
        return F.substring(F.lit("ACGT"), place.cast("int") + 1, F.lit(1))
    return F.concat(_letter(h), letter) if kind == "insert" else F.lit("")


def mutated(parts: DataFrame, n: int, kind: str, seed: int = 1) -> DataFrame:
    """(ref_id, at, seq): pieces (ref_id, at, seq) with n places of every sequence changed: kind is substitute (by another letter), insert (a
    letter before the place) or delete. Places of pieces move by what is put in or left out before them; an emptied piece goes."""
    if kind not in ("substitute", "insert", "delete"):
        raise ValueError(f"no such change: {kind}")
    edits = sampled_places(parts, n, seed).groupBy("ref_id", "at").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("edits"))
    rows = parts.join(edits, ["ref_id", "at"], "left").withColumn("edits", F.coalesce("edits", F.array().cast("array<struct<i:int,h:bigint>>")))
    # the text between the places, with each place's new letters after it
    ends = F.transform("edits", lambda e: e["i"])
    gaps = F.transform("edits", lambda e, k: F.concat(_between(F.col("seq"), F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1), e["i"]), _edited(F.substring(F.col("seq"), e["i"] + 1, F.lit(1)), e["h"], kind)))
    last = F.coalesce(F.element_at(ends, F.when(F.size(ends) > 0, -1).otherwise(F.lit(None))) + 1, F.lit(0))
    rows = rows.select("ref_id", "at", F.size("edits").alias("n"), F.concat(F.array_join(gaps, ""), _between(F.col("seq"), last, F.char_length("seq"))).alias("seq"))
    moved = {"substitute": 0, "insert": 1, "delete": -1}[kind]
    if not moved:
        return rows.select("ref_id", "at", "seq")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ref_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("ref_id", (F.col("at") + before * moved).alias("at"), "seq").where("seq <> ''")


def _between(seq: Column, start: Column, end: Column) -> Column:
    return F.substring(seq, start + 1, end - start)


def joined(parts: DataFrame) -> DataFrame:
    """(ref_id, seq) of pieces, for sequences that fit a row."""
    listed = parts.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("p"))
    return listed.select("ref_id", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))
