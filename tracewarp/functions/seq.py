"""Sequences: complement, 2-bit k-mer codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal import bound


def clean(text: Column) -> Column:
    """The letters A, C, G, T of a text; U counts as T."""
    return F.regexp_replace(F.translate(F.upper(text), "U", "T"), "[^ACGT]+", "")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def differences(a: Column, b: Column) -> Column:
    """In how many places two ASCII texts differ; places that only the longer one has are among them."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = ((np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)) for u, v in zip(x, y, strict=True))
        return pd.Series([np.count_nonzero(u[: len(v)] != v[: len(u)]) + abs(len(u) - len(v)) for u, v in pairs], dtype="int64")

    return run(a.cast("binary"), b.cast("binary"))


def kmer_code(kmer: Column, k: int) -> Column:
    """2 bits a base, the first one highest; ambiguous bases count as A."""
    code = F.lit(0)
    for i in range(k):
        base = F.substring(kmer, i + 1, 1)
        code = code * 4 + F.when(base == "C", 1).when(base == "G", 2).when(base.isin("T", "U"), 3).otherwise(0)
    return code


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence; none if it is shorter. Letters are looked up in an array, as a place in a string takes a scan."""

    def body(c):
        every = F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*(F.get(c, i + j) for j in range(k))))
        return F.when(F.size(c) >= k, every).otherwise(F.array().cast("array<string>"))

    return bound(F.split(seq, ""), body)


def common_prefix(texts: Column) -> Column:
    """The longest prefix that all texts of an array share."""

    def both(x, y):
        n = F.least(F.char_length(x), F.char_length(y))
        lengths = F.filter(F.sequence(F.lit(0), n), lambda k: F.left(x, k) == F.left(y, k))
        return F.left(x, F.array_max(lengths))

    return F.aggregate(texts, F.get(texts, F.lit(0)), both)


def field_after(text: Column, key: str) -> Column:
    """What follows the last ``key`` in a text up to the next underscore; null where the key isn't there."""
    return F.when(F.contains(text, F.lit(key)), F.split_part(F.element_at(F.split(text, r"\Q" + key + r"\E"), -1), F.lit("_"), F.lit(1)))


def run_settings(name: Column) -> Column:
    """(preset, fill, radius, border) of a run's name such as preset_dtwfillmethod_banded=0.1_dtwborderconstraint_sparse."""
    fill, border = field_after(name, "dtwfillmethod_"), field_after(name, "dtwborderconstraint_")
    radius = field_after(name, "dtwfillmethod_banded=").try_cast("double")
    return F.struct(F.split_part(name, F.lit("_"), F.lit(1)).alias("preset"), fill.alias("fill"), radius.alias("radius"), border.alias("border"))


def named(text: Column, names: list[tuple[str, str]]) -> Column:
    """The name that goes with the first part that a text holds, or the text itself."""
    out = None
    for part, name in names:
        out = F.when(F.contains(text, F.lit(part)), name) if out is None else out.when(F.contains(text, F.lit(part)), name)
    return text if out is None else out.otherwise(text)


def kmer_counts(rows: DataFrame, text: str, k: int) -> DataFrame:
    """(code, n) of all k-mers, k <= 10, of the letters A, C, G, T of texts (U counts as T): tasks count codes of two bits a letter in an
    array of 4^k numbers, and only these are shuffled."""
    letters = np.full(256, 4, np.uint8)
    for code, both in enumerate(("Aa", "Cc", "Gg", "TtUu")):
        for c in both.encode():
            letters[c] = code

    def run(batches):
        total = np.zeros(4**k, np.int64)
        for b in batches:
            for x in b.column(0):
                d = letters[np.frombuffer(x.as_py() or b"", np.uint8)]
                d = d[d < 4].astype(np.int32)
                if len(d) >= k:
                    codes = d[: len(d) - k + 1]
                    for j in range(1, k):
                        codes = codes * 4 + d[j : len(d) - k + 1 + j]
                    total += np.bincount(codes, minlength=4**k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    found = rows.select(F.col(text).cast("binary")).mapInArrow(run, "code long, n long")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def kmer_of(code: Column, k: int) -> Column:
    """The letters of a code of two bits each."""
    return F.concat(*(F.substring(F.lit("ACGT"), F.shiftright(code, 2 * (k - 1 - j)).bitwiseAND(F.lit(3).cast("long")).cast("int") + 1, F.lit(1)) for j in range(k)))
