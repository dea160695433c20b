"""User functions where built-in expressions have no form: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def pdep(value: pd.Series, mask: pd.Series) -> pd.Series:
    """Bits of ``value``, from the lowest, put where ``mask`` has ones."""
    v, m = value.to_numpy(np.int64).view(np.uint64), mask.to_numpy(np.int64).view(np.uint64)
    out, taken = np.zeros(len(v), np.uint64), np.zeros(len(v), np.uint64)
    for k in range(64):
        here = (m >> np.uint64(k)) & np.uint64(1)
        out |= (((v >> taken) & here) << np.uint64(k))
        taken = np.minimum(taken + here, np.uint64(63))
    return pd.Series(out.view(np.int64))


@F.pandas_udf(T.LongType())
def bitcast_f64(x: pd.Series) -> pd.Series:
    """The bits of a double as an integer."""
    return pd.Series(x.to_numpy(np.float64).view(np.int64))


@F.pandas_udf(T.DoubleType())
def bitcast_i64(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy(np.int64).view(np.float64))


def geo_mean(c: Column | str) -> Column:
    """Geometric mean of positive values as an aggregate of built-ins: it has partial sums, unlike a pandas aggregate."""
    x = F.col(c) if isinstance(c, str) else c
    return F.exp(F.avg(F.when(x > 0, F.ln(F.when(x > 0, x)))))


def filter_with(df: DataFrame, value: str, keep: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Rows for which a vectorised predicate of the user holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keep(b[value]).astype(bool)]

    return df.mapInPandas(run, df.schema)


@F.udtf(returnType="bit int, is_set boolean")
class ExplodeBits:
    """Rows (bit, is_set) for the low ``n`` bits of an integer."""

    def eval(self, value: int, n: int):
        for k in range(n):
            yield k, bool(value >> k & 1)
