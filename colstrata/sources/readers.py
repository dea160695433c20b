"""Sources: Parquet, CSV columns, raw binary arrays, in-memory arrays; sinks: Parquet and metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["from_array", "from_list", "from_numpy", "load_csv", "load_parquet", "raw_f64", "LargeData", "write_metrics", "write_parquet", "write_raw"]


def load_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table, or some of its columns; filters and columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def from_numpy(spark: SparkSession, values: np.ndarray, name: str = "x") -> DataFrame:
    """``(row_idx, <name> double)`` of a one-dimensional array; NaN stays NaN."""
    a = np.ascontiguousarray(values, dtype=np.float64).ravel()
    return spark.createDataFrame(pa.table({"row_idx": pa.array(np.arange(len(a))), name: pa.array(a)}))


def from_list(spark: SparkSession, values: Iterable[float | None], name: str = "x") -> DataFrame:
    """``(row_idx, <name> double)`` of a list; None is null."""
    values = list(values)
    return spark.createDataFrame(pa.table({"row_idx": pa.array(range(len(values)), pa.int64()), name: pa.array([None if v is None else float(v) for v in values], pa.float64())}))


from_array = from_numpy


def load_csv(spark: SparkSession, path: str, column: int | str = 0, name: str = "x", header: bool = True) -> DataFrame:
    """One column of CSV files as double; cells that are not numbers are dropped."""
    raw = spark.read.csv(path, header=header, inferSchema=False, enforceSchema=False)
    picked = raw.columns[column] if isinstance(column, int) else column
    value = F.col(f"`{picked}`").try_cast("double")
    return raw.select(value.alias(name)).where(F.col(name).isNotNull())


def raw_f64(spark: SparkSession, path: str, name: str = "x") -> DataFrame:
    """``(row_idx, <name> double)`` of a headerless file of little-endian doubles.

    Spark splits the file in fixed-length records, so no task holds more than its split.  row_idx counts records in
    file order; it costs one extra pass that counts the splits.  A file whose size is no multiple of 8 is an error.
    """
    records = spark.sparkContext.binaryRecords(path, 8)

    def decode(part: Iterator) -> Iterator:
        held, first = [], None
        for record, at in part:
            first = at if first is None else first
            held.append(record)
            if len(held) == 65_536:
                yield first, b"".join(held)
                held, first = [], None
        if held:
            yield first, b"".join(held)

    blocks = spark.createDataFrame(records.zipWithIndex().mapPartitions(decode), "first long, block binary")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(block, "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x))), pa.array(x)], ["row_idx", name])

    return blocks.mapInArrow(unpack, f"row_idx long, {name} double")


class LargeData:
    """Aggregates over a file or array of doubles, whole or in chunks; Spark's partitions are the chunks."""

    def __init__(self, df: DataFrame, name: str = "x"):
        self.df, self.name = df, name

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> LargeData:
        return cls(raw_f64(spark, path))

    @classmethod
    def from_array(cls, spark: SparkSession, values: np.ndarray) -> LargeData:
        return cls(from_numpy(spark, values))

    def sum(self, threshold: float | None = None) -> float:
        df = self.df if threshold is None else self.df.where((F.col(self.name) > threshold) & ~F.isnan(self.name))
        return df.agg(F.coalesce(F.sum(self.name), F.lit(0.0))).first()[0]

    def count_above(self, threshold: float) -> int:
        return self.df.where((F.col(self.name) > threshold) & ~F.isnan(self.name)).count()

    def chunked_sum(self, rows: int) -> DataFrame:
        """``(chunk, n, sum)`` for chunks of ``rows`` consecutive rows."""
        chunk = F.floor(F.col("row_idx") / rows)
        return self.df.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.sum(self.name).alias("sum"))

    def __len__(self) -> int:
        return self.df.count()


def write_parquet(df: DataFrame, path: str, *partition: str, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_raw(spark: SparkSession, path: str, values: np.ndarray) -> None:
    """An array that the driver holds as a headerless file of little-endian doubles; the file must be new."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(np.ascontiguousarray(values, dtype="<f8").tobytes()))
    out.close()


def write_metrics(metrics: DataFrame, path: str, form: str = "json") -> None:
    """A table of metrics (see plans.metrics) as JSON lines or CSV."""
    if form not in ("json", "csv"):
        raise ValueError("json or csv")
    getattr(metrics.write.mode("overwrite"), form)(path, **({"header": True} if form == "csv" else {}))

