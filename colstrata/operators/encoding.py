"""Column encodings as relational operators, and statistics that choose between them.  Parquet applies its own; these
make the codes visible to queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import rle
from .ordered import Ranges, row_index, running_sum, spare


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """``(code, value)``: the sorted distinct values, numbered from 0."""
    return row_index(df.select(value).where(F.col(value).isNotNull()).distinct(), [value], "code").select("code", value)


def dictionary_encode(df: DataFrame, value: str, codes: DataFrame | None = None) -> DataFrame:
    """``df`` with ``code`` for ``value``; null has none."""
    return df.join(codes if codes is not None else dictionary(df, value), value, "left")


def dictionary_decode(encoded: DataFrame, codes: DataFrame) -> DataFrame:
    return encoded.join(codes, "code", "left")


def rle_decode(runs: DataFrame, value: str) -> DataFrame:
    """``(run, offset, value)``: one row per row of the encoded series."""
    return runs.select("run", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)).alias("offset"), value)


def delta_encode(df: DataFrame, value: str, order: str) -> DataFrame:
    """``df`` with ``delta``: the difference to the row before, of the first row to 0."""
    (last,) = spare(df, "last")
    r = Ranges(df, [order])
    return r.done(r.before(r.df, F.col(value), last).withColumn("delta", F.col(value) - F.coalesce(last, F.lit(0))).drop(last))


def delta_decode(df: DataFrame, order: str, alias: str = "value") -> DataFrame:
    return running_sum(df, F.col("delta"), [order], alias)


def bit_width(value: str):
    """Bits that the largest of a column's non-negative values needs, as an aggregate."""
    return F.length(F.bin(F.max(F.col(value).cast("long"))))


def frame_of_reference(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``scaled``: the value's place between the column's least and greatest in 2**31 - 1 steps (lossy)."""
    lo, hi = spare(df, "lo", "hi")
    ends = df.agg(F.min(value).alias(lo), F.max(value).alias(hi))
    step = (F.col(hi) - F.col(lo)) / 2147483647
    scaled = F.when(F.col(hi) > F.col(lo), F.round((F.col(value) - F.col(lo)) / F.when(step > 0, step))).otherwise(0.0)
    return df.join(F.broadcast(ends)).withColumn("scaled", scaled.cast("long")).drop(lo, hi)  # one row


def column_stats(df: DataFrame, value: str) -> DataFrame:
    """``(n, nulls, distinct, lo, hi)`` of a column."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.count_distinct(value).alias("distinct"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def zone_map(df: DataFrame, value: str, zone) -> DataFrame:
    """``(zone, n, lo, hi, nulls)`` per zone; a zone whose range misses a predicate can be skipped."""
    return df.groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value).isNull()).alias("nulls"))


def suggest(df: DataFrame, value: str, order: str) -> DataFrame:
    """``(encoding, rows, distinct, runs)``: runs if they are few, else a dictionary if values repeat, else plain."""
    n = df.agg(F.count("*").alias("rows"), F.count_distinct(value).alias("distinct"))
    r = rle(df, value, order).agg(F.count("*").alias("runs"))
    kind = F.when(F.col("runs") * 4 <= F.col("rows"), "rle").when(F.col("distinct") * 2 <= F.col("rows"), "dictionary").otherwise("plain")
    return n.join(F.broadcast(r)).select(kind.alias("encoding"), "rows", "distinct", "runs")  # one row each


