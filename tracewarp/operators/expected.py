"""Expected signals of sequences by a pore model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import revcomp
from ..functions.signal import bound, discrete_normalize, zscore


def level_list(model: DataFrame, k: int) -> DataFrame:
    """One row with ``levels``, the 4^k mean levels in order of the k-mers' codes; k-mers that the model lacks have level 0."""
    every = model.sparkSession.range(4**k).withColumnRenamed("id", "code").join(F.broadcast(model.select("code", "level_mean")), "code", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("code", F.coalesce("level_mean", F.lit(0.0)).alias("x")))).alias("l"))
    return rows.select(F.transform("l", lambda s: s["x"]).alias("levels"))


def lookup(seq: Column, levels: Column, k: int) -> Column:
    """The level of every k-mer of a sequence; ambiguous bases count as A, and a sequence shorter than k has none."""
    digits = F.transform(F.split(F.translate(F.regexp_replace(F.upper(seq), "[^ACGTU]", "A"), "ACGTU", "01233"), ""), lambda c: c.cast("int"))

    def of(d):
        def level(i):
            code = F.lit(0)
            for j in range(k):
                code = code * 4 + F.get(d, i + j)
            return F.get(levels, code)

        return F.when(F.size(d) >= k, F.transform(F.sequence(F.lit(0), F.size(d) - k), level)).otherwise(F.array().cast("array<double>"))

    return bound(digits, of)


def expected_signals(refs: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """refs (ref_id, seq) as (ref_id, strand, signal): z-scored levels of both strands, ready for build_index().

    The model is one row of 4^k numbers, which a scalar subquery hands to the scan; nothing is shuffled.
    """
    both = refs.select("ref_id", "seq", level_list(model, k).scalar().alias("levels"))
    strands = both.select("ref_id", "levels", F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col("seq").alias("s")), F.struct(F.lit(1).alias("strand"), revcomp(F.col("seq")).alias("s")))).alias("x"))
    return strands.select("ref_id", F.col("x.strand").alias("strand"), bound(lookup(F.col("x.s"), F.col("levels"), k), zscore).alias("signal"))


def stepped_reference(refs: DataFrame, model: DataFrame, k: int, both: bool = True) -> DataFrame:
    """refs (ref_id, seq) as (ref_id, signal): discrete levels for warping. A strand has as many samples as bases; its last k are 0
    before they are normalised. The reverse strand follows the forward one unless ``both`` is false."""

    def strand(s):
        n = F.char_length(s)
        filled = F.slice(lookup(s, F.col("levels"), k), 1, F.greatest(n - k, F.lit(0)))
        zeros = F.array_repeat(F.lit(0.0), F.least(n, F.lit(k)))
        return bound(F.transform(F.concat(filled, zeros), lambda x: x * 100), lambda a: discrete_normalize(a))

    rows = refs.where(F.char_length("seq") > 0).select("ref_id", "seq", level_list(model, k).scalar().alias("levels"))
    forward = strand(F.col("seq"))
    return rows.select("ref_id", (F.concat(forward, strand(revcomp(F.col("seq")))) if both else forward).alias("signal"))
