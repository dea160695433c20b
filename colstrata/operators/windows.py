"""Rolling, centred and value-range windows, and time buckets.

A window over a series of one key is partitioned by it.  A series without a key is cut in blocks of consecutive
rows that carry the few rows of their neighbours which frames reach, so it needs no single task either.
Rolling windows are full: the first ``window - 1`` rows of a series have none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, Ranges, blocks, spare

Agg = Callable[[WindowSpec], Column]


def framed(df: DataFrame, order: str, low: int, high: int, made: dict[str, Agg], keys: Sequence[str] = (), full: bool = False, block: int = 1 << 20, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with columns ``made`` over the row frame [low, high]; only rows whose frame has all its rows before the
    current one, if ``full``.  ``order`` must be total within ``keys``.

    The table is dealt to ranges and blocks in the order of ``keys`` and ``order``, so a key of very many rows is no single
    task; a frame ends where its key does.
    """
    at, home, own, seen = spare(df, "at", "block", "own", "seen")
    made = dict(made)
    if full:
        made[seen] = lambda w: F.count(F.lit(1)).over(w)
    r = Ranges(df, [*keys, order], rows)
    if r.one and (keys or block >= rows):  # one range: no frame crosses it
        cut, w = r.df, Window.partitionBy(r.part, *keys).orderBy(order)
    else:
        indexed = r.running(r.df, F.lit(1).cast("long"), at).withColumn(at, F.col(at) - 1)
        cut, w = blocks(indexed, at, home, own, max(0, -low), max(0, high), block), Window.partitionBy(home, *keys).orderBy(at)
    made_ = {k: f(w.rowsBetween(low, 0) if k == seen else w.rowsBetween(low, high)) for k, f in made.items()}
    out = cut.withColumns(made_)
    if own in out.columns:
        out = out.where(own).drop(home, own, at)
    return r.done((out.where(F.col(seen) > -low) if full else out).drop(seen))


def rolling(df: DataFrame, value: str, order: str, window: int, what: str = "mean", keys: Sequence[str] = (), alias: str | None = None, q: float = 0.5, block: int = 1 << 20) -> DataFrame:
    """Trailing window of ``window`` rows: sum, mean, min, max, stddev, variance (population), quantile (interpolated)."""
    c = F.col(value)
    made: dict[str, Agg] = {
        "sum": lambda w: F.sum(c).over(w),
        "mean": lambda w: F.avg(c).over(w),
        "min": lambda w: F.min(c).over(w),
        "max": lambda w: F.max(c).over(w),
        "stddev": lambda w: F.stddev_pop(c).over(w),
        "variance": lambda w: F.var_pop(c).over(w),
        "quantile": lambda w: F.percentile(c, F.lit(q)).over(w),
    }
    return framed(df, order, -(window - 1), 0, {alias or what: made[what]}, keys, True, block)


def delta(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), alias: str = "delta", lag: int = 1, block: int = 1 << 20) -> DataFrame:
    """Difference to the row ``lag`` before; the first ``lag`` rows of a series are left out."""
    return framed(df, order, -lag, -lag, {alias: lambda w: F.col(value) - F.first(value).over(w)}, keys, True, block)


def centred(df: DataFrame, value: str, order: str, reach: int, made: Sequence[str] = ("sum", "avg", "min", "max"), keys: Sequence[str] = (), block: int = 1 << 20) -> DataFrame:
    """Frame of ``reach`` rows on either side, cut off at the ends; ``frame_rank``: 1 + smaller values in the frame."""
    c = F.col(value)
    all_: dict[str, Agg] = {
        "sum": lambda w: F.sum(c).over(w),
        "avg": lambda w: F.avg(c).over(w),
        "min": lambda w: F.min(c).over(w),
        "max": lambda w: F.max(c).over(w),
        "values": lambda w: F.collect_list(c).over(w),
    }
    wanted = {("values" if m == "frame_rank" else m): all_["values" if m == "frame_rank" else m] for m in made}
    out = framed(df, order, -reach, reach, wanted, keys, False, block)
    if "frame_rank" in made:
        out = out.withColumn("frame_rank", F.lit(1) + F.size(F.filter("values", lambda x: x < c))).drop("values")
    return out


def value_range(df: DataFrame, value: str, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with range_count, range_sum, range_avg over the rows whose value is within ``radius`` of the row's.

    Without a key the values are dealt to cells of 64 radii; a cell also gets the rows within the radius of its ends.  A
    radius of 0 takes equal values.  A null value is within no radius: its count is 0 and its sum and average are null.
    """
    c = F.col(value)

    def over(cells: Sequence[str]) -> dict[str, Column]:
        by = ", ".join(f"`{x}`" for x in cells)
        frame = f"(PARTITION BY {by} ORDER BY `{value}` RANGE BETWEEN {float(radius)}D PRECEDING AND {float(radius)}D FOLLOWING)"
        return {f"range_{k}": F.expr(f"{k}(`{value}`) OVER {frame}") for k in ("count", "sum", "avg")}

    if keys:
        return df.withColumns(over(keys))
    if radius == 0:
        w = Window.partitionBy(value)
        return df.withColumns({"range_count": F.count(c).over(w), "range_sum": F.sum(c).over(w), "range_avg": F.avg(c).over(w)})
    at, cell = spare(df, "home", "cell")
    width = 64 * radius
    home = F.floor(c / width)
    cells = F.array_distinct(F.array(home, F.floor((c - radius) / width), F.floor((c + radius) / width)))
    dealt = df.withColumn(at, home).withColumn(cell, F.explode(cells))
    return dealt.withColumns(over([cell])).where(F.col(cell).eqNullSafe(F.col(at))).drop(cell, at)


def tumbling(df: DataFrame, ts: str, value: str, seconds: int, fill: bool = False, alias: str = "sum", start: int = 0) -> DataFrame:
    """``(bucket, <alias>)``: sums per bucket of ``seconds`` since epoch second ``start``; earlier rows are left out.  ``fill``
    adds buckets without rows, as 0."""
    at = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 - start) / seconds)
    out = df.withColumn("bucket", at).where("bucket >= 0").groupBy("bucket").agg(F.sum(value).alias(alias))
    if not fill:
        return out
    span = out.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo IS NOT NULL")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("bucket"))
    return every.join(out, "bucket", "left").withColumn(alias, F.coalesce(alias, F.lit(0)))
