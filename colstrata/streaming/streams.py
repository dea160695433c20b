"""Structured Streaming: running aggregates, event-time windows, sessions and deduplication.

Sources are folders of Parquet files; a query runs over all that is there and stops (available now), with its state
and progress in a checkpoint folder, so a restart goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of the Parquet files in ``folder``, ``files`` per batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def event_time(stream: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """The stream with ``ts`` as a timestamp (of a zone-free one: UTC) and a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def filter_sum(stream: DataFrame, value: str, threshold: float) -> DataFrame:
    """Running ``(sum, count)`` of values above the threshold (complete mode)."""
    return stream.where((F.col(value) > threshold) & ~F.isnan(value)).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"), F.count("*").alias("count"))


def tumbling(stream: DataFrame, ts: str, value: str, length: str, delay: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(start, keys, n, sum)`` per window of ``length``."""
    return sliding(stream, ts, value, length, None, delay, keys)


def sliding(stream: DataFrame, ts: str, value: str, length: str, slide: str | None, delay: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = event_time(stream, ts, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "sum")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, value: str, delay: str = "1 hour") -> DataFrame:
    """``(key, start, end, n, sum)`` per session: rows of a key less than ``gap`` apart."""
    out = event_time(stream, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sum")


def deduplicated(stream: DataFrame, ts: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return event_time(stream, ts, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run over what is there and return the sink's table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append mode to Parquet; exactly once with the checkpoint."""
    stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """A user function on every micro-batch; ``handle`` should be idempotent in the batch number."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Feed:
    """A stream fed with arrays: ``feed`` adds a file to its folder, ``flush`` runs what is new, results accumulate."""

    def __init__(self, spark: SparkSession, folder: str, threshold: float, value: str = "x"):
        from ..sources import from_list

        self.spark, self.folder, self.value, self.threshold = spark, folder.rstrip("/"), value, threshold
        self.name = f"feed_{uuid.uuid4().hex}"
        self._like = from_list(spark, [0.0], value)

    def feed(self, values: Iterable[float] | np.ndarray) -> None:
        from ..sources import from_numpy

        from_numpy(self.spark, np.asarray(values, float), self.value).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def flush(self) -> tuple[float, int]:
        """(sum, count) of all values over the threshold that were fed so far."""
        total: list[tuple[float, int]] = []

        def keep(batch: DataFrame, _: int) -> None:
            r = batch.first()
            total.append((r["sum"], r["count"]))

        running = filter_sum(source(self.spark, f"{self.folder}/in", self._like, 1000), self.value, self.threshold)
        running.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if total:
            self._last = total[-1]
        return getattr(self, "_last", (0.0, 0))


def stream_filter_sum(spark: SparkSession, chunks: Iterable, threshold: float, folder: str) -> float:
    """The sum over ``threshold`` of a generator of arrays."""
    feed = Feed(spark, folder, threshold)
    for chunk in chunks:
        feed.feed(chunk)
    return feed.flush()[0]
