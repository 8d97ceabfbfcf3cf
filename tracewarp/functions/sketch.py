"""Quantised events and seed hashes as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .signal import bound

MASK32 = (1 << 32) - 1


def quantize(x: Column) -> Column:
    """Sign, one exponent bit and three more: the level of a normalised event by powers of two (zero counts as the lowest power)."""
    power = F.when(F.abs(x) < 2.0**-126, -127).otherwise(F.floor(F.log2(F.abs(x))))
    return (F.when(x < 0, 16).otherwise(0) + F.when(F.abs(x) >= 2, 8).otherwise(0) + F.pmod(power + 127, F.lit(8))).cast("long")


def hash_mix(k: Column) -> Column:
    """An invertible 32-bit integer mix with shifts and sums; arguments and results are non-negative."""
    mask = F.lit(MASK32).cast("long")
    m = lambda c: c.bitwiseAND(mask)
    steps = [
        lambda x: m(m(x.bitwiseXOR(mask)) + m(F.shiftleft(x, 21))), lambda x: x.bitwiseXOR(F.shiftright(x, 24)), lambda x: m(x + m(F.shiftleft(x, 3)) + m(F.shiftleft(x, 8))),
        lambda x: x.bitwiseXOR(F.shiftright(x, 14)), lambda x: m(x + m(F.shiftleft(x, 2)) + m(F.shiftleft(x, 4))), lambda x: x.bitwiseXOR(F.shiftright(x, 28)), lambda x: m(x + m(F.shiftleft(x, 31))),
    ]
    for step in steps:  # each step's argument becomes a variable, as it stands in the step more than once
        k = bound(k, step)
    return k


def kept_events(a: Column, least: float = 0.3, chunk: int = 256, last: Column | None = None) -> Column:
    """(pos, value) of the events that differ from the last kept one by at least ``least``, which the fold carries. The result grows
    chunk by chunk, so that a long signal isn't copied for each event. ``last`` is the last one kept before the array (null: none)."""
    kind = "array<struct<pos:int,value:double>>"
    every = F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.cast("double").alias("value")))

    def keep(acc, x):
        new = acc["last"].isNull() | (F.abs(x["value"] - acc["last"]) >= least)
        return F.struct(F.when(new, x["value"]).otherwise(acc["last"]).alias("last"), F.when(new, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    def fold(events):
        def part(acc, k):
            inner = F.aggregate(F.slice(events, k * chunk + 1, F.lit(chunk)), F.struct(acc["last"].alias("last"), F.array().cast(kind).alias("out")), keep)
            return bound(inner, lambda x: F.struct(x["last"].alias("last"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        before = F.lit(None) if last is None else last
        start = F.struct(before.cast("double").alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(events) - 1) / chunk).cast("int"))
        return F.when(F.size(events) > 0, F.aggregate(chunks, start, part, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(kind))

    return bound(every, fold)


def distinct_events(a: Column, least: float = 0.3) -> Column:
    """Events that differ from the last kept one by at least ``least``."""
    return F.transform(kept_events(a, least), lambda x: x["value"])


def seeds(events: Column, e: int = 6, bits: int = 5) -> Column:
    """(pos, hash) of every window of e quantised events; pos is that of the last event."""
    codes = F.transform(events, quantize)

    def body(c):
        def one(i):
            packed = F.lit(0).cast("long")
            for j in range(e):
                packed = packed.bitwiseOR(F.shiftleft(F.get(c, i + j), bits * (e - 1 - j)))
            return F.struct((i + e - 1).alias("pos"), hash_mix(packed.bitwiseAND(F.lit(MASK32).cast("long"))).alias("hash"))

        return F.when(F.size(c) >= e, F.transform(F.sequence(F.lit(0), F.size(c) - e), one)).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return F.get(F.transform(F.array(codes), body), F.lit(0))


def minimizers(events: Column, e: int = 6, w: int = 5, bits: int = 5) -> Column:
    """(pos, hash) of the seeds that are the lowest of some w seeds in a row, ties included; pos is that of the first event.

    Fewer than w seeds count as one window.
    """

    def body(s):
        width = F.least(F.lit(w), F.size(s))
        lows = F.transform(F.sequence(F.lit(0), F.size(s) - width), lambda i: F.array_min(F.transform(F.slice(s, i + 1, width), lambda x: x["hash"])))

        def lowest(low):
            def some(x, j):
                first = F.greatest(j - width + 1, F.lit(0))
                return F.array_contains(F.slice(low, first + 1, F.least(j, F.size(s) - width) - first + 1), x["hash"])

            return F.transform(F.filter(s, some), lambda x: F.struct((x["pos"] - (e - 1)).alias("pos"), x["hash"].alias("hash")))

        return F.when(F.size(s) > 0, bound(lows, lowest)).otherwise(s)

    return bound(seeds(events, e, bits), body)


def sketch(events: Column, e: int = 6, w: int = 0, least: float | None = None) -> Column:
    """Every seed, or the minimizers over w seeds. With ``least``, events that differ less from the last kept one are left out
    first, and positions are those of the kept events in the whole signal."""
    of = lambda x: minimizers(x, e, w) if w else seeds(x, e)
    if least is None:
        return of(events)
    moved = lambda kept: F.transform(of(F.transform(kept, lambda x: x["value"])), lambda x: F.struct(F.get(kept, x["pos"])["pos"].alias("pos"), x["hash"].alias("hash")))
    return bound(kept_events(events, least), moved)


def seeds_of(x: np.ndarray, e: int = 6, w: int = 0, least: float | None = None, bits: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of sketch() for one signal, for code that holds signals itself."""
    at = np.arange(len(x))
    if least is not None and len(x):
        kept = [0]
        for i, v in enumerate(x):
            if abs(v - x[kept[-1]]) >= least:
                kept.append(i)
        at = np.array(kept)
    y = x[at]
    if len(y) < e:
        return np.zeros(0, int), np.zeros(0, np.int64)
    size = np.abs(y)
    power = np.where(size < 2.0**-126, -127, np.floor(np.log2(np.maximum(size, 2.0**-126)))).astype(np.int64)
    codes = np.where(y < 0, 16, 0) + np.where(size >= 2, 8, 0) + (power + 127) % 8
    k = np.zeros(len(y) - e + 1, np.int64)
    for j in range(e):
        k |= codes[j : len(codes) - e + 1 + j] << bits * (e - 1 - j)
    k &= MASK32
    k = ((k ^ MASK32) + (k << 21 & MASK32)) & MASK32
    k ^= k >> 24
    k = (k + (k << 3) + (k << 8)) & MASK32
    k ^= k >> 14
    k = (k + (k << 2) + (k << 4)) & MASK32
    k ^= k >> 28
    k = (k + (k << 31)) & MASK32
    if not w:
        return at[e - 1 :], k
    width = min(w, len(k))
    low = np.lib.stride_tricks.sliding_window_view(k, width).min(1)
    edge = np.full(width - 1, -1)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, low, edge]), width)
    some = (around == k[:, None]).any(1)
    return at[: len(k)][some], k[some]
