"""Aggregates beyond the built-in ones, and the merging of partial states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, Ranges, spare


def samp_var(c: Column | str) -> Column:
    """Sample variance; 0 for fewer than two rows."""
    return F.coalesce(F.var_samp(c), F.lit(0.0))


def samp_std(c: Column | str) -> Column:
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def pop_std(c: Column | str) -> Column:
    return F.coalesce(F.stddev_pop(c), F.lit(0.0))


def grouped(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """sum, count, min, max, avg and sample variance and deviation per group; partial aggregation before the shuffle."""
    return df.groupBy(*keys).agg(
        F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), samp_var(value).alias("variance"), samp_std(value).alias("stddev")
    )


def first_by(value: str, *order: str) -> Column:
    """The value of the first row by ``order``; as an aggregate it needs no sort."""
    return F.min_by(value, F.struct(*order))


def last_by(value: str, *order: str) -> Column:
    return F.max_by(value, F.struct(*order))


def mode(value: str) -> Column:
    """The most frequent value, the smallest of equals."""
    return F.mode(value, True)


def nearest_rank(df: DataFrame, value: str, p: float, keys: Sequence[str] = ()) -> DataFrame:
    """The value at rank floor(p * n) (from 0, at most n - 1) of each group's sorted values.

    The distinct values' counts are summed up instead of the rows, so a group's rows meet in no task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    w = Window.partitionBy(*keys)
    up = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(w)
    rank = F.least(F.floor(F.lit(p) * total), total - 1)
    ranked = counts.select(*keys, value, F.sum("count").over(up).alias("upto"), rank.alias("rank"))
    return ranked.where("upto > rank").groupBy(*keys).agg(F.min(value).alias("percentile"))


def count_nonzero(value: str) -> Column:
    return F.count_if((F.col(value) != 0) & ~F.isnan(F.col(value).cast("double")))


def any_nonzero(value: str) -> Column:
    return F.bool_or(F.col(value) != 0)


def all_nonzero(value: str) -> Column:
    return F.bool_and(F.col(value) != 0)


def state(value: str) -> list[Column]:
    """A mergeable state: n, sum, mean, m2 (sum of squared deviations), min, max."""
    c = F.col(value).cast("double")
    return [F.count(c).alias("n"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"), F.min(c).alias("lo"), F.max(c).alias("hi")]


def save_state(states: DataFrame, path: str) -> None:
    """Write states, to go on from later; the folder must be new."""
    states.write.parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """States that were saved in ``path`` or in folders below it; ``merge`` puts them together."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def merge(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merge states of disjoint parts to count, sum, mean, sample variance, min and max.

    Squares are summed about the mean of all parts: those within the parts, and those of the parts' means, so values far
    from 0 lose no digits.  States are as few as partial aggregation left.
    """
    mean, off = spare(states, "mean", "off")
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    known = states.where("n > 0").withColumn(mean, F.sum("sum").over(w) / F.sum("n").over(w))
    known = known.withColumn(off, F.col("mean") - F.col(mean))
    n = F.sum("n")
    m2 = F.sum(F.col("m2") + F.col("n") * F.col(off) * F.col(off))
    var = F.when(n > 1, m2 / F.when(n > 1, n - 1)).otherwise(0.0)
    return known.groupBy(*keys).agg(n.alias("count"), F.sum("sum").alias("sum"), F.first(mean).alias("mean"), var.alias("variance"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def runs(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """Runs of equal consecutive values: ``(keys, run, value, length, first)``; run counts from 0 within ``keys``.  Runs go on
    from range to range, so neither a series nor a key is a single task."""
    last, fresh = spare(df, "last", "fresh")
    r = Ranges(df.select(*keys, value, order), [*keys, order], rows)
    here = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v"))
    marked = r.before(r.df, here, last)
    same = F.col(last).isNotNull() & F.col(value).eqNullSafe(F.col(last)["v"])
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(last)[f"k{i}"])
    marked = r.running(marked.withColumn(fresh, (~same).cast("long")), F.col(fresh), "run")
    out = marked.groupBy(*keys, (F.col("run") - 1).alias("run")).agg(F.first(value).alias(value), F.count("*").alias("length"), F.min(order).alias("first"))
    if not keys:
        return out
    (start,) = spare(out, "start")
    starts = out.groupBy(*keys).agg(F.min("run").alias(start)).toDF(*[f"__{k}_" for k in keys], start)
    joined = out.join(starts, [F.col(k).eqNullSafe(F.col(f"__{k}_")) for k in keys])
    return joined.withColumn("run", F.col("run") - F.col(start)).select(*out.columns)


def rle(df: DataFrame, value: str, order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``(run, value, length, first)`` of a series without a key."""
    return runs(df, value, order, (), rows)
