"""Set operations over rows, with and without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(a.columns))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b.select(a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(a.columns))


def difference_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(a.columns))


def hash_partition(df: DataFrame, key: str, parts: int, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``df`` with ``part``, 0 to ``parts`` - 1, the same for equal keys, and dealt to as many Spark partitions by it, so that
    what follows by key needs no other shuffle."""
    part = F.pmod(hashed(F.col(key)), F.lit(parts)).cast("int")
    return df.withColumn("part", part).repartition(parts, "part")
