"""Fluent, lazy queries over one value column of a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bounds import Bounds
from . import aggregates


def comparable(c: Column, double: bool) -> Column:
    """True where a comparison with ``c`` may hold: NaN passes none."""
    return ~F.isnan(c) if double else F.lit(True)


class Frame:
    """A DataFrame, a value column and pending predicates.  All filters hold together; nothing runs before ``run``.

    ``order`` names the columns that make row order total (row_idx by default, where there is one).
    """

    def __init__(self, df: DataFrame, value: str = "x", order: tuple[str, ...] | None = None, bounds: Bounds | None = None, result: DataFrame | None = None):
        self.df, self.value = df, value
        self.order = order if order is not None else (("row_idx",) if "row_idx" in df.columns else ())
        self.bounds = bounds or Bounds()
        self._result = result

    @classmethod
    def from_list(cls, spark: SparkSession, values: list) -> Frame:
        from ..sources import from_list

        return cls(from_list(spark, values))

    @classmethod
    def from_numpy(cls, spark: SparkSession, values: np.ndarray) -> Frame:
        from ..sources import from_numpy

        return cls(from_numpy(spark, values))

    def _with(self, **changed) -> Frame:
        return Frame(**({"df": self.df, "value": self.value, "order": self.order, "bounds": self.bounds, "result": self._result} | changed))

    # filters: literal bounds are tightened before they reach the plan
    def filter_gt(self, t) -> Frame:
        return self._with(bounds=self.bounds.above(t, strict=True))

    def filter_ge(self, t) -> Frame:
        return self._with(bounds=self.bounds.above(t, strict=False))

    def filter_lt(self, t) -> Frame:
        return self._with(bounds=self.bounds.below(t, strict=True))

    def filter_le(self, t) -> Frame:
        return self._with(bounds=self.bounds.below(t, strict=False))

    def filter_eq(self, t) -> Frame:
        return self.filter_ge(t).filter_le(t)

    def filter_ne(self, t) -> Frame:
        return self._with(bounds=self.bounds.without(t))

    def between(self, low, high) -> Frame:
        """Both ends belong to the range."""
        return self.filter_ge(low).filter_le(high)

    def is_null(self) -> Frame:
        return self.where(F.col(self.value).isNull())

    def is_not_null(self) -> Frame:
        return self.where(F.col(self.value).isNotNull())

    def where(self, condition: Column | str) -> Frame:
        return self._with(df=self.df.where(condition))

    def frame(self) -> DataFrame:
        """The rows that pass, with all their columns."""
        condition = self.bounds.condition(F.col(f"`{self.value}`"), dict(self.df.dtypes)[self.value] in ("double", "float"))
        return self.df if condition is None else self.df.where(condition)

    # results
    def _agg(self, column: Column) -> Frame:
        return self._with(result=self.frame().agg(column))

    def sum(self) -> Frame:
        return self._agg(F.coalesce(F.sum(self.value), F.lit(0)).alias("sum"))

    def count(self) -> Frame:
        return self._agg(F.count(self.value).alias("count"))

    def min(self) -> Frame:
        return self._agg(F.min(self.value).alias("min"))

    def max(self) -> Frame:
        return self._agg(F.max(self.value).alias("max"))

    def avg(self) -> Frame:
        return self._agg(F.avg(self.value).alias("avg"))

    def sort(self, ascending: bool = True) -> Frame:
        """Rows in stable order of the value; row_idx of the result is the sorting permutation."""
        key = F.asc(self.value) if ascending else F.desc(self.value)
        return self._with(result=self.frame().orderBy(key, *self.order))

    def topk(self, k: int, largest: bool = True) -> Frame:
        key = F.desc_nulls_last(self.value) if largest else F.asc_nulls_last(self.value)
        return self._with(result=self.frame().orderBy(key, *self.order).limit(k))

    def bottomk(self, k: int) -> Frame:
        return self.topk(k, largest=False)

    def group_by(self, *keys: str) -> Frame:
        return self._with(result=aggregates.grouped(self.frame(), keys, self.value))

    def run(self) -> DataFrame:
        """The result's DataFrame; the sum where nothing else was asked for."""
        return self._result if self._result is not None else self.sum()._result

    def value_of(self):
        """The single value of a one-cell result."""
        return self.run().first()[0]


def filter_and_sum(df: DataFrame, value: str, threshold) -> DataFrame:
    return Frame(df, value).filter_gt(threshold).sum().run()


def filter_and_count(df: DataFrame, value: str, threshold) -> DataFrame:
    return Frame(df, value).filter_gt(threshold).count().run()


def group_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("sum"))
