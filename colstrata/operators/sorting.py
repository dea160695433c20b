"""Stable sorts, sort permutations and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Key, row_index


def sort_stable(df: DataFrame, value: str, index: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(value) if ascending else F.desc_nulls_last(value), index)


def sort_index(df: DataFrame, value: str, index: str, ascending: bool = True) -> DataFrame:
    """``(pos, index)``: the permutation that sorts ``value``, of any ordered type; equal values keep their order, nulls come
    last.  Ranges are numbered where they are."""
    order = [Key(value, not ascending, True), Key(index)]
    return row_index(df.select(value, index), order, "pos").select("pos", index)


def topk(df: DataFrame, value: str, index: str, k: int, largest: bool = True) -> DataFrame:
    """The ``k`` rows of largest (smallest) value, by value then index; each task keeps k rows."""
    return df.orderBy(F.desc_nulls_last(value) if largest else F.asc_nulls_last(value), index).limit(k)


def distinct_sorted(df: DataFrame, value: str) -> DataFrame:
    return df.select(value).distinct().orderBy(value)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in an order drawn by a hash of the row and ``seed``; reruns agree."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns))
