"""A stream of mapped reads that tells when the shares of the references have settled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TICKS = "tick long, reads long, distance double, stop boolean"


def outlier_distance(shares: list[np.ndarray]) -> float:
    """The largest squared distance met when each vector in turn is compared with the farthest one so far, starting from the first."""
    at, far = shares[0], 0.0
    for v in shares:
        d = float(((v - at) ** 2).sum())
        if d > far:
            at, far = v, d
    return far


class Settled(StatefulProcessor):
    """Sums by reference, and a ring with the shares at the last ticks: all that is kept, however many reads have come."""

    def __init__(self, every: int, least_reads: int, ring: int, limit: float):
        self.every, self.least_reads, self.ring, self.limit = every, least_reads, ring, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "reads long, ticks long, stopped boolean")
        self.sums = handle.getValueState("sums", "k array<long>, total array<double>")
        self.shares = handle.getValueState("shares", "slots array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reads, ticks, stopped = self.count.get() if self.count.exists() else (0, 0, False)
        if stopped:
            return
        known, total = (list(x) for x in self.sums.get()) if self.sums.exists() else ([], [])
        slots = [np.asarray(x, float) for x in self.shares.get()[0]] if self.shares.exists() else []
        new = pd.concat(list(rows)).sort_values("read_id", kind="stable")
        place, out = {k: i for i, k in enumerate(known)}, []
        for k in new["k"].unique():
            place.setdefault(int(k), len(place))
        sums = np.zeros(len(place))
        sums[: len(total)] = total
        at, lengths = new["k"].map(place).to_numpy(), new["length"].to_numpy(float)
        done = 0
        while done < len(at) and not stopped:
            step = min(self.every - reads % self.every, len(at) - done)
            np.add.at(sums, at[done : done + step], lengths[done : done + step])
            reads, done = reads + step, done + step
            if reads % self.every == 0 and reads > self.least_reads:
                slots = slots + [sums * 0] if len(slots) < self.ring else slots
                slots[ticks % self.ring] = sums / sums.sum()
                ticks += 1
                wide = [np.pad(x, (0, len(sums) - len(x))) for x in slots]
                distance = outlier_distance(wide)
                stopped = ticks > self.ring and distance <= self.limit
                out.append((ticks, reads, distance, stopped))
        self.count.update((int(reads), int(ticks), bool(stopped)))
        self.sums.update((list(place), sums.tolist()))
        if slots:
            self.shares.update(([x.tolist() for x in slots],))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TICKS.split(", ")])

    def close(self) -> None:
        pass


def settled(mapped: DataFrame, every: int, limit: float, least_reads: int = 0, ring: int = 5) -> DataFrame:
    """A row (TICKS) after every ``every`` mapped reads past the first ``least_reads``, up to the one that stops: the outlier distance among
    the last ``ring`` ticks' shares, which lie in slots that are reused in turn. A tick stops if as many ticks went before and the
    distance is within the limit.

    mapped is a stream (read_id, k, length). Reads count in the order of the triggers and, within one, of read_id: that order is the
    whole table's, so all reads pass one task, in 24 bytes each and without being kept.
    """
    rows = mapped.select(F.lit(0).alias("all"), F.col("read_id").cast("long"), F.col("k").cast("long"), F.col("length").cast("double"))
    return rows.groupBy("all").transformWithStateInPandas(Settled(every, least_reads, ring, limit), TICKS, "Append", "None")
