"""Row selection by position and by predicate sets; element-wise updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import row_index


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def and_not(a: Column, b: Column) -> Column:
    """Rows of ``a`` that ``b`` doesn't hold for; where ``b`` is null it doesn't hold."""
    return a & ~F.coalesce(b, F.lit(False))


def negate(a: Column) -> Column:
    """Rows for which ``a`` doesn't hold, nulls among them."""
    return ~F.coalesce(a, F.lit(False))


def first_passing(df: DataFrame, condition: Column, order: str, k: int) -> DataFrame:
    """The first ``k`` rows in ``order`` that pass."""
    return df.where(condition).orderBy(order).limit(k)


def slice_rows(df: DataFrame, index: str, start: int, length: int) -> DataFrame:
    return df.where(F.col(index).between(start, start + length - 1))


def strided(df: DataFrame, index: str, step: int, offset: int = 0) -> DataFrame:
    """Every ``step``-th row from ``offset`` on."""
    return df.where((F.col(index) >= offset) & ((F.col(index) - offset) % step == 0))


def gather(df: DataFrame, index: str, positions: DataFrame, at: str, missing=None) -> DataFrame:
    """``positions`` with the columns of the row at ``at``; where there is none, null or ``missing``."""
    out = positions.join(df.withColumnRenamed(index, at), at, "left")
    return out if missing is None else out.fillna(missing)


def scatter(df: DataFrame, index: str, value: str, updates: DataFrame, at: str, new: str) -> DataFrame:
    """``df`` with ``value`` replaced by ``new`` in the rows that ``updates`` names by ``at``; the last by value of several."""
    last = updates.groupBy(F.col(at).alias(index)).agg(F.max(new).alias("_new"))
    return df.join(last, index, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def fill_range(df: DataFrame, index: str, value: str, start: int, end: int, new) -> DataFrame:
    """``value`` set to ``new`` in rows start to end - 1."""
    return df.withColumn(value, F.when(F.col(index).between(start, end - 1), F.lit(new)).otherwise(F.col(value)))


def masked(df: DataFrame, mask: Column, value: str, new: Column) -> DataFrame:
    return df.withColumn(value, F.when(mask, new).otherwise(F.col(value)))


def reverse(df: DataFrame, index: str) -> DataFrame:
    return df.orderBy(F.desc(index))


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Per column its nulls and values, and whether any or all are null."""
    out = []
    for c in columns or df.columns:
        out += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.count(c).alias(f"{c}_valid"), F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(f"{c}_any_null"), F.coalesce(F.bool_and(F.col(c).isNull()), F.lit(False)).alias(f"{c}_all_null")]
    return df.agg(*out)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """``(rows, hash)``: an order-free hash of the rows."""
    h = F.xxhash64(*(columns or df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).alias("hash"))


def compare(a: str | Column, b: str | Column) -> Column:
    """-1, 0 or 1: the order of two arrays by their first different elements, then by length."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0).cast("int")


def compare_series(a: DataFrame, b: DataFrame, value: str, order: str) -> DataFrame:
    """``(sign)``: -1, 0 or 1, the order of two columns by their first different values, then by length.  Values are put
    side by side by their numbers in ``order``; only the first difference is kept on the way."""
    x = row_index(a.select(order, F.struct(F.col(value).alias("v")).alias("x")), [order], "at").drop(order)
    y = row_index(b.select(order, F.struct(F.col(value).alias("v")).alias("y")), [order], "at").drop(order)
    sign = F.when(F.col("x").isNull(), -1).when(F.col("y").isNull(), 1).when(F.col("x") < F.col("y"), -1).when(F.col("x") > F.col("y"), 1).otherwise(0)
    both = x.join(y, "at", "full").withColumn("sign", sign).where("sign <> 0")
    return both.agg(F.coalesce(F.min_by("sign", "at"), F.lit(0)).cast("int").alias("sign"))
