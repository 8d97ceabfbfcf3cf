"""How long a sequencing run takes when reads are rejected by their scores: survival over stages, channels and thresholds.

Scores are counted by bin first: a read's bin at a stage is the number of thresholds up to its score. Whoever passes the first stages at a
combination of thresholds is then a cumulative count over as many dimensions, so reads never meet thresholds in a join, and
everything after the count has a row for each combination.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunModel:
    """A run's constants: share of targets, mean lengths and trims in samples, samples and bases a second, seconds, and what is wanted."""

    target_share: float = 0.01
    target_length: float = 11814.0
    other_length: float = 12551.0
    target_trim: float = 0.0
    samples_a_second: float = 4000.0
    bases_a_second: float = 400.0
    reverse_bases_a_second: float = 100_000.0
    capture: float = 1.0
    device_latency: float = 0.070
    genome: float = 30_000.0
    coverage: float = 30.0
    bias: float = 10.0
    #: Of what decides: samples a second and seconds a decision.
    throughput: float = 23_364.0 * 2000
    latency: float = 0.0000408

    def shares(self) -> tuple[float, float]:
        return self.target_share, 1 - self.target_share

    def simple(self) -> tuple[float, float, float]:
        """(useful seconds, all seconds, sequenced seconds) a read that nothing rejects."""
        (a, b), rate = self.shares(), self.samples_a_second
        busy = a * self.target_length / rate + b * self.other_length / rate
        return a * (self.target_length - self.target_trim) / rate, busy + (a + b) * self.capture, busy

    def wanted(self) -> float:
        """Samples that the run has to gather."""
        return self.genome * (self.samples_a_second / self.bases_a_second) * self.coverage * self.bias

    def rejected(self, prefix: float) -> float:
        """Seconds that a read takes which is rejected after so many samples: more of it is read meanwhile, and has to be reversed."""
        rate, wait = self.samples_a_second, self.latency + self.device_latency
        back = (prefix + rate * wait) / (self.reverse_bases_a_second * (rate / self.bases_a_second))
        return self.capture + prefix / rate + wait + back


def simple_runtime(channels: Column, m: RunModel = RunModel()) -> Column:
    """Seconds of a run without rejection."""
    useful, total, _ = m.simple()
    return F.lit(m.wanted()) / (channels * m.samples_a_second * useful / total)


def survivors(scores: DataFrame, stages: list[tuple[str, list[float]]], target: str = "target") -> DataFrame:
    """(thr_1, ..., thr_k, kept_t_0, kept_o_0, ..., kept_t_k, kept_o_k): targets and others whose scores are under the thresholds of the first j
    stages, for every combination of thresholds; stages lists columns of scores with thresholds. Null scores never pass."""
    levels = [sorted(set(t)) for _, t in stages]
    passed = lambda c, t: F.size(F.filter(F.array(*map(F.lit, t)), lambda x: x <= F.col(c)))
    bins = [F.when(F.col(c).isNull(), len(t)).otherwise(passed(c, t)).alias(f"b{i}") for i, ((c, _), t) in enumerate(zip(stages, levels, strict=True), 1)]
    counts = scores.select(F.col(target).alias("target"), *bins).groupBy("target", *(f"b{i}" for i in range(1, len(stages) + 1))).agg(F.count(F.lit(1)).alias("n"))
    both = lambda n: [F.sum(F.when(F.col("target"), F.col(n)).otherwise(0)).alias("t"), F.sum(F.when(~F.col("target"), F.col(n)).otherwise(0)).alias("o")]
    total = counts.agg(*both("n"))
    out = None
    for j in range(1, len(stages) + 1):
        keys = [f"b{i}" for i in range(1, j + 1)]
        grid = scores.sparkSession.range(1)
        for i, t in enumerate(levels[:j], 1):
            grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(t) - 1))).alias(f"b{i}"))
        rows = grid.join(counts.groupBy(*keys).agg(*both("n")), keys, "left")
        for d in keys:
            run = Window.partitionBy(*(k for k in keys if k != d)).orderBy(d)
            rows = rows.select(*keys, *(F.sum(F.coalesce(x, F.lit(0))).over(run).alias(x) for x in "to"))
        rows = rows.select(*keys, F.col("t").alias(f"kept_t_{j}"), F.col("o").alias(f"kept_o_{j}"))
        out = rows.join(out, keys[:-1]) if j > 1 else rows.select("*", *(F.coalesce(total.select(x).scalar(), F.lit(0)).alias(f"kept_{x}_0") for x in "to"))
    places = [F.element_at(F.array(*map(F.lit, map(float, t))), F.col(f"b{i}") + 1).alias(f"thr_{i}") for i, t in enumerate(levels, 1)]
    return out.select(*places, *(f"kept_{x}_{j}" for j in range(len(stages) + 1) for x in "to"))


def runtimes(kept: DataFrame, prefixes: list[int], channels: list[float], m: RunModel = RunModel()) -> DataFrame:
    """survivors() for each number of channels with ``duration``, the run's seconds, and ``deciding``, the share of channels for which the
    throughput of what decides suffices; the others run as without rejection. prefixes has the samples a stage decides after."""
    (a, b), rate = m.shares(), m.samples_a_second
    n = len(prefixes)
    rejected = {x: sum(((F.col(f"kept_{x}_{j}") - F.col(f"kept_{x}_{j + 1}")) * m.rejected(p) for j, p in enumerate(prefixes)), F.lit(0.0)) for x in "to"}
    target, other = F.col(f"kept_t_{n}") * a, F.col(f"kept_o_{n}") * b
    useful = target * ((m.target_length - m.target_trim) / rate)
    total = rejected["t"] * a + target * (m.capture + m.target_length / rate) + rejected["o"] * b + other * (m.capture + m.other_length / rate)
    simple_useful, simple_total, busy = m.simple()
    rows = kept.withColumn("channels", F.explode(F.array(*map(F.lit, map(float, channels)))))
    most = F.col("channels") * rate
    deciding = F.least(F.lit(1.0), F.lit(m.throughput) / (most * (busy / simple_total)))
    rows = rows.withColumn("deciding", deciding)
    share = F.col("deciding") * F.coalesce(F.try_divide(useful, total), F.lit(0.0)) + (1 - F.col("deciding")) * (simple_useful / simple_total)
    return rows.withColumn("duration", F.lit(m.wanted()) / (share * most + 0.0001))
