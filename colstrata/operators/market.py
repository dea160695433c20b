"""Market indicators over price series: a total order, prices, volumes, and a column ``symbol`` where there are several.

Every indicator is defined within a symbol.  A table without that column is one series: it is cut in ranges and blocks of
rows (``windows``), so it needs no single task.  Hourly data: KYEAR periods a year.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows
from .ordered import RANGE_ROWS, Ranges, row_index, spare

KYEAR = 365 * 24
TINY = 1e-10


def _keys(df: DataFrame) -> list[str]:
    return ["symbol"] if "symbol" in df.columns else []


def _framed(df: DataFrame, order: str, low: int, made: dict[str, windows.Agg], full: bool = False) -> DataFrame:
    return windows.framed(df, order, low, 0, made, _keys(df), full)


def _per(df: DataFrame, *made: Column) -> DataFrame:
    """One row a symbol, or one row."""
    return df.groupBy(*_keys(df)).agg(*made)


def vwap(price: str = "price", volume: str = "volume") -> Column:
    """Aggregate: price weighted by volume; 0 without volume."""
    v = F.sum(volume)
    return F.when(v > 0, F.sum(F.col(price) * F.col(volume)) / F.when(v > 0, v)).otherwise(0.0)


def returns(df: DataFrame, period: int = 1, order: str = "ts", log: bool = False, alias: str = "ret") -> DataFrame:
    """Change of the price over ``period`` rows; rows without one, or after a price of 0, are left out."""
    (last,) = spare(df, "last")
    out = _framed(df, order, -period, {last: lambda w: F.first("price").over(w)}, True)
    ratio = F.try_divide(F.col("price"), F.col(last))
    out = out.withColumn(alias, F.ln(F.when(ratio > 0, ratio)) if log else ratio - 1).drop(last)
    return out.where(F.col(alias).isNotNull())


def log_returns(df: DataFrame, period: int = 1, order: str = "ts") -> DataFrame:
    return returns(df, period, order, True)


def rolling(df: DataFrame, window: int, what: str, value: str = "price", order: str = "ts") -> DataFrame:
    return windows.rolling(df, value, order, window, what, _keys(df))


def volatility(df: DataFrame, window: int = 20, order: str = "ts") -> DataFrame:
    """``(symbol, volatility)``: mean rolling population deviation of returns, a year."""
    sd = _framed(returns(df, 1, order), order, -(window - 1), {"sd": lambda w: F.stddev_pop("ret").over(w)}, True)
    return _per(sd, (F.avg("sd") * KYEAR**0.5).alias("volatility"))


def bollinger(df: DataFrame, window: int = 20, width: float = 2.0, order: str = "ts") -> DataFrame:
    (sd,) = spare(df, "sd")
    out = _framed(df, order, -(window - 1), {"middle": lambda w: F.avg("price").over(w), sd: lambda w: F.stddev_pop("price").over(w)}, True)
    return out.withColumns({"upper": F.col("middle") + width * F.col(sd), "lower": F.col("middle") - width * F.col(sd)}).drop(sd)


def rsi(df: DataFrame, window: int = 14, order: str = "ts") -> DataFrame:
    """Relative strength of simple averages over ``window`` price changes."""
    step, gain, loss = spare(df, "step", "gain", "loss")
    d = _framed(df, order, -1, {step: lambda w: F.col("price") - F.first("price").over(w)}, True)
    mean = lambda sign: lambda w: F.avg(F.greatest(sign * F.col(step), F.lit(0.0))).over(w)
    out = _framed(d, order, -(window - 1), {gain: mean(1), loss: mean(-1)}, True)
    ratio = F.col(gain) / F.when(F.col(loss) == 0, TINY).otherwise(F.col(loss))
    return out.withColumn("rsi", 100 - 100 / (1 + ratio)).drop(step, gain, loss)


def _exponential(df: DataFrame, value: str, span: int, alias: str, index: str) -> DataFrame:
    """``df`` with the exponential average of ``value``, alpha = 2 / (span + 1), over rows numbered from 0 in ``index`` within a
    symbol; it starts with the first value.

    An average is an affine map of the one before, so the averages of a block are sums of weighted values, all at once.
    What goes in from before a block fades; blocks are so long that it has faded below any digit (10 ** -50) a block later, so
    each is a window of its own over its rows and those of the block before.
    """
    q = 1 - 2 / (span + 1)
    if q <= 0:
        return df.withColumn(alias, F.col(value).cast("double"))
    size = max(2, math.ceil(50 * math.log(10) / -math.log(q)))
    home, block = spare(df, "home", "block")
    rows = df.withColumn(home, F.floor(F.col(index) / size))
    rows = rows.withColumn(block, F.explode(F.array(F.col(home), F.col(home) + 1)))
    at = (F.col(index) - (F.col(block) - 1) * size).cast("double")
    share = F.when(F.col(index) == 0, 1.0).otherwise(1 - q)
    inside = Window.partitionBy(*_keys(df), block).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.col(value) * share * F.pow(F.lit(1 / q), at)).over(inside) * F.pow(F.lit(q), at)
    return rows.withColumn(alias, own).where(F.col(home) == F.col(block)).drop(home, block)


def _numbered(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> tuple[DataFrame, str]:
    """Rows with a price, numbered within their symbol; long series are numbered range by range too."""
    (index,) = spare(df, "index")
    keys = _keys(df)
    rows_ = df.select(*keys, order, F.col("price").cast("double").alias("price")).where("price IS NOT NULL")
    out = row_index(rows_, [*keys, order], index, rows)
    if keys:
        first = out.groupBy("symbol").agg(F.min(index).alias("first")).withColumnRenamed("symbol", "own")
        out = out.join(first, F.col("symbol").eqNullSafe(F.col("own"))).withColumn(index, F.col(index) - F.col("first")).drop("first", "own")
    return out, index


def ema(df: DataFrame, span: int = 20, order: str = "ts", rows: int = RANGE_ROWS) -> DataFrame:
    """``(symbol, order, price, ema)``: exponential average, alpha = 2 / (span + 1), from the first price on; rows without a
    price are left out."""
    out, index = _numbered(df, order, rows)
    return _exponential(out, "price", span, "ema", index).drop(index)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, order: str = "ts", rows: int = RANGE_ROWS) -> DataFrame:
    """``(symbol, order, price, macd, signal, histogram)``."""
    out, index = _numbered(df, order, rows)
    f, s = spare(out, "fast", "slow")
    out = _exponential(_exponential(out, "price", fast, f, index), "price", slow, s, index)
    out = out.withColumn("macd", F.col(f) - F.col(s)).drop(f, s)
    return _exponential(out, "macd", signal, "signal", index).withColumn("histogram", F.col("macd") - F.col("signal")).drop(index)


def _with(df: DataFrame, per: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row a symbol (or one row, which is broadcast)."""
    if not _keys(df):
        return df.join(F.broadcast(per))
    return df.join(per.withColumnRenamed("symbol", "__symbol"), F.col("symbol").eqNullSafe(F.col("__symbol"))).drop("__symbol")


def time_ohlc(df: DataFrame, seconds: int = 3600, fill: bool = True, order: str = "ts") -> DataFrame:
    """``(symbol, bucket, open, high, low, close, volume)`` per bucket of ``seconds`` since the series' first row; buckets
    without rows are zeros, if ``fill``."""
    t, first = spare(df, "t", "first")
    keys = _keys(df)
    b = df.withColumn(t, F.unix_micros(F.col(order).cast("timestamp")))
    b = _with(b, _per(b, F.min(t).alias(first))).withColumn("bucket", F.floor((F.col(t) - F.col(first)) / (seconds * 1_000_000)))
    bars = b.groupBy(*keys, "bucket").agg(F.min_by("price", t).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", t).alias("close"), F.sum("volume").alias("volume"))
    if not fill:
        return bars
    every = _per(bars, F.max("bucket").alias("hi")).where("hi IS NOT NULL").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi"))).alias("bucket"))
    return every.join(bars, [*keys, "bucket"], "left").fillna(0, ["open", "high", "low", "close", "volume"])


def resample_ohlc(df: DataFrame, window: int = 100, order: str = "ts", rows: int = RANGE_ROWS) -> DataFrame:
    """Bars of ``window`` rows; an incomplete last bar is left out."""
    (n,) = spare(df, "n")
    keys = _keys(df)
    r = Ranges(df, [*keys, order], rows)
    numbered = r.done(r.running_in(r.df, keys, F.lit(1).cast("long"), n)).withColumn(n, F.col(n) - 1) if keys else row_index(df, [order], n, rows)
    bars = numbered.withColumn("bar", F.floor(F.col(n) / window)).groupBy(*keys, "bar")
    bars = bars.agg(F.min_by("price", n).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", n).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias(n))
    return bars.where(F.col(n) == window).drop(n)


def sharpe(rf: float = 0.02) -> Column:
    """Aggregate over ``ret``."""
    return (F.avg("ret") - rf / KYEAR) / (F.stddev_pop("ret") + TINY) * KYEAR**0.5


def sortino(rf: float = 0.02) -> Column:
    down = F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret")))
    return F.when(F.count_if(F.col("ret") < 0) > 0, (F.avg("ret") - rf / KYEAR) / (down + TINY) * KYEAR**0.5).otherwise(0.0)


def value_at_risk(df: DataFrame, window: int = 250, confidence: float = 0.95, order: str = "ts") -> DataFrame:
    return _framed(returns(df, 1, order), order, -(window - 1), {"var": lambda w: F.percentile("ret", F.lit(1 - confidence)).over(w)}, True)


def max_drawdown(df: DataFrame, order: str = "ts", rows: int = RANGE_ROWS) -> DataFrame:
    (top,) = spare(df, "top")
    keys = _keys(df)
    r = Ranges(df, [*keys, order], rows)
    out = r.running_in(r.df, keys, F.col("price"), top, "max") if keys else r.running(r.df, F.col("price"), top, "max")
    return _per(out, F.min(F.try_divide(F.col("price") - F.col(top), F.col(top))).alias("max_drawdown"))


def paired_returns(df: DataFrame, a: str, b: str, order: str = "ts") -> DataFrame:
    """``(n, x, y)``: the i-th returns of symbols ``a`` and ``b`` side by side."""
    one = lambda s, name: row_index(returns(df.where(F.col("symbol") == s).drop("symbol"), 1, order).select(order, F.col("ret").alias(name)), [order], "n").drop(order)
    return one(a, "x").join(one(b, "y"), "n")


def correlation(df: DataFrame, a: str, b: str, order: str = "ts") -> DataFrame:
    return paired_returns(df, a, b, order).agg(F.corr("x", "y").alias("correlation"))


def beta(df: DataFrame, asset: str, market: str, order: str = "ts") -> DataFrame:
    """Sample covariance over population variance; 0 if the market doesn't move."""
    v = F.var_pop("y")
    return paired_returns(df, asset, market, order).agg(F.when(v > 0, F.covar_samp("x", "y") / F.when(v > 0, v)).otherwise(0.0).alias("beta"))


def stats(df: DataFrame, order: str = "ts", rf: float = 0.02, window: int = 20) -> DataFrame:
    """One row per symbol: count, sum, mean, min, max, std (population), vwap, volatility, sharpe, sortino, max_drawdown,
    skewness and (non-excess) kurtosis of returns."""
    base = _per(df, F.count("*").alias("count"), F.sum("price").alias("sum"), F.avg("price").alias("mean"), F.min("price").alias("min"), F.max("price").alias("max"), F.stddev_pop("price").alias("std"), vwap().alias("vwap"))
    r = returns(df, 1, order)
    mean, c = spare(r, "mean", "c")
    d = _with(r, _per(r, F.avg("ret").alias(mean))).withColumn(c, F.col("ret") - F.col(mean))
    sd = F.stddev_pop("ret")
    moments = _per(d, sharpe(rf).alias("sharpe"), sortino(rf).alias("sortino"), (F.avg(F.pow(c, F.lit(3))) / (F.pow(sd, F.lit(3)) + TINY)).alias("skewness"), (F.avg(F.pow(c, F.lit(4))) / (F.pow(sd, F.lit(4)) + TINY)).alias("kurtosis"))
    if not _keys(df):
        return base.join(volatility(df, window, order)).join(moments).join(max_drawdown(df, order))  # one row each
    return base.join(volatility(df, window, order), "symbol", "left").join(moments, "symbol", "left").join(max_drawdown(df, order), "symbol", "left")


class MarketData:
    """A table of series, with the indicators as methods.  Without a column ``symbol`` it is one series."""

    def __init__(self, df: DataFrame, order: str = "ts"):
        self.df, self.order = df, order

    @classmethod
    def from_arrays(cls, spark, prices: Sequence[float], volumes=None, timestamps=None) -> MarketData:
        n = len(prices)
        p = pd.DataFrame({"ts": np.arange(n) if timestamps is None else timestamps, "price": np.asarray(prices, float), "volume": np.ones(n) if volumes is None else np.asarray(volumes, float)})
        return cls(spark.createDataFrame(p))

    def __len__(self) -> int:
        return self.df.count()

    def _agg(self, name: str, c: Column) -> DataFrame:
        return _per(self.df, c.alias(name))

    def sum(self, column: str = "price") -> DataFrame:
        return self._agg("sum", F.sum(column))

    def mean(self, column: str = "price") -> DataFrame:
        return self._agg("mean", F.avg(column))

    def count_above(self, threshold: float, column: str = "price") -> DataFrame:
        return self._agg("count_above", F.count_if((F.col(column) > threshold) & ~F.isnan(F.col(column).cast("double"))))

    def sum_above(self, threshold: float, column: str = "price") -> DataFrame:
        above = (F.col(column) > threshold) & ~F.isnan(F.col(column).cast("double"))
        return self._agg("sum_above", F.coalesce(F.sum(F.when(above, F.col(column))), F.lit(0.0)))

    def vwap(self) -> DataFrame:
        return self._agg("vwap", vwap())

    def sharpe(self, rf: float = 0.02) -> DataFrame:
        return _per(returns(self.df, 1, self.order), sharpe(rf).alias("sharpe"))

    def sortino(self, rf: float = 0.02) -> DataFrame:
        return _per(returns(self.df, 1, self.order), sortino(rf).alias("sortino"))

    def __getattr__(self, name: str):
        what = name.removeprefix("rolling_")
        if what != name and what in ("mean", "sum", "min", "max", "stddev", "variance"):
            return lambda window, **k: rolling(self.df, window, what, order=self.order, **k)
        f = {"var": value_at_risk}.get(name) or globals().get(name)
        if f in _METHODS:
            return lambda *a, **k: f(self.df, *a, order=self.order, **k)
        raise AttributeError(name)


_METHODS = (returns, log_returns, rolling, volatility, bollinger, rsi, ema, macd, time_ohlc, resample_ohlc, value_at_risk, max_drawdown, correlation, beta, stats)
