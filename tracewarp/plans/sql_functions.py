"""The kernels as SQL functions: scalar ones over arrays, and table functions for lateral joins.

    SELECT r.id, s.pos, s.hash FROM reads r, LATERAL sketch(r.signal, 6) s
    SELECT dtw_global(a, b), dtw_banded(a, b, 10), sdtw(a, b), detect_events(signal) FROM pairs
    SELECT p.* FROM pairs, LATERAL dtw_path(a, b) p

Scalar functions take Arrow batches. Nulls in give nulls out, and no rows from table functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, NumericType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.sketch import seeds_of
from ..operators.dtw import batch_costs, path
from ..operators.events import detect


def _costs(a: pd.Series, b: pd.Series, kind: str = "global", radius: int | None = None) -> pd.Series:
    return pd.Series(batch_costs(list(a), list(b), kind, radius), index=a.index).astype("Float64").mask(a.isna() | b.isna())


@F.pandas_udf(DoubleType())
def dtw_global(a: pd.Series, b: pd.Series) -> pd.Series:
    return _costs(a, b)


@F.pandas_udf(DoubleType())
def dtw_banded(a: pd.Series, b: pd.Series, radius: pd.Series) -> pd.Series:
    out = pd.Series(index=a.index, dtype="Float64")
    for r, part in radius.groupby(radius):
        out[part.index] = _costs(a[part.index], b[part.index], "antidiagonal", int(r))
    return out


@F.pandas_udf(DoubleType())
def sdtw(a: pd.Series, b: pd.Series) -> pd.Series:
    return _costs(a, b, "free")


@F.pandas_udf(ArrayType(DoubleType()))
def detect_events(signal: pd.Series) -> pd.Series:
    return signal.map(lambda x: None if x is None else detect(np.asarray(x, float)))


def _signals(*arguments: AnalyzeArgument) -> None:
    for a in arguments:
        if a.isTable or not isinstance(a.dataType, ArrayType) or not isinstance(a.dataType.elementType, NumericType):
            raise ValueError("a signal is an array of numbers")


class Sketch:
    """sketch(signal, e [, w [, least]]): (pos, hash) of each seed of e events, of the minimizers over w seeds with w > 0, without
    events that differ from the last kept one by less than ``least``."""

    @staticmethod
    def analyze(signal: AnalyzeArgument, e: AnalyzeArgument, w: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        _signals(signal)
        for x in (e, w):
            if x is not None and (not isinstance(x.dataType, IntegerType) or isinstance(x.dataType, BooleanType) or not x.isConstantExpression):
                raise ValueError("e and w are whole constants")
        return AnalyzeResult(StructType().add("pos", "integer").add("hash", "long"))

    def eval(self, signal, e: int, w: int = 0, least=None) -> Iterator[tuple]:
        if signal is not None:
            pos, hashes = seeds_of(np.asarray(signal, float), e, w, None if least is None else float(least))
            yield from zip(pos.tolist(), hashes.tolist(), strict=True)


class Path:
    """dtw_path(a, b [, free]): the cells (step, i, j, d) of the best alignment of a with b, or with the best part of it."""

    @staticmethod
    def analyze(a: AnalyzeArgument, b: AnalyzeArgument, free: AnalyzeArgument | None = None) -> AnalyzeResult:
        _signals(a, b)
        return AnalyzeResult(StructType().add("step", "integer").add("i", "integer").add("j", "integer").add("d", "double"))

    def eval(self, a, b, free: bool = False) -> Iterator[tuple]:
        if a is not None and b is not None:
            for step, (i, j, d) in enumerate(path(np.asarray(a, float), np.asarray(b, float), free)[1]):
                yield step, i, j, d


def register(spark: SparkSession) -> None:
    """Registers sketch, dtw_path, dtw_global, dtw_banded, sdtw and detect_events in the session."""
    for name, f in (("dtw_global", dtw_global), ("dtw_banded", dtw_banded), ("sdtw", sdtw), ("detect_events", detect_events)):
        spark.udf.register(name, f)
    for name, table in (("sketch", Sketch), ("dtw_path", Path)):
        spark.udtf.register(name, F.udtf(table))
