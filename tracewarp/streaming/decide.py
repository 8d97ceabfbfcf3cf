"""Chunk-by-chunk decisions on a stream of traces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stage_decisions(chunks: DataFrame, template: list[float], stages: list[tuple[int, float]], idle_ms: int = 60_000) -> DataFrame:
    """A row (read_id, seen, cost, keep) for each read once a stage rejects it or it passes the last one.

    chunks has (read_id, chunk, signal). The state of a read is its last row of costs against the template, the samples seen
    and the stages passed; chunks of one trigger are taken in the order of their numbers. Reads idle too long are evicted.
    """
    r = np.asarray(template, float)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        row, seen, passed, done = state.get if state.exists else (None, 0, 0, False)
        row = None if row is None else np.asarray(row, float)
        decision = None
        for signal in pd.concat(list(batches)).sort_values("chunk")["signal"] if not done else []:
            for x in np.asarray(signal, float):
                if done:
                    break
                cost = np.abs(x - r)
                if row is None:
                    row = cost
                else:
                    total = cost.cumsum()
                    best = np.minimum(row, np.concatenate([[np.inf], row[:-1]])) + cost
                    row = np.minimum.accumulate(best - total) + total
                seen += 1
                if passed < len(stages) and seen == stages[passed][0]:
                    keep = row.min() <= stages[passed][1]
                    passed += 1
                    if not keep or passed == len(stages):
                        done, decision = True, (key[0], seen, float(row.min()), bool(keep))
        state.update(([] if row is None else row.tolist(), seen, passed, done))
        state.setTimeoutDuration(idle_ms)
        if decision:
            yield pd.DataFrame([decision], columns=["read_id", "seen", "cost", "keep"])

    return chunks.groupBy("read_id").applyInPandasWithState(step, "read_id long, seen int, cost double, keep boolean", "row array<double>, seen int, passed int, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
