"""Helpers shared by the training-data operators: durable materialisation, graph components, small guards."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast; the callers count first and have another plan beyond it.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch for Python; without it Spark takes 10,000 rows, however long their texts are.
BATCH_BYTES = 2 << 20
_written: list[tuple[SparkSession, str]] = []
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir; a local folder only where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            path = _local_dir()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="colstrata-")


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, a lost executor loses nothing.

    The files are deleted by ``release``, or when the driver's interpreter exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/colstrata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def bounded(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES`` (one longer row is a batch), unless it has a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of that name in the shared folder, deleted when the driver's interpreter exits."""
    path = f"{shared_dir(spark)}/colstrata-{name}"
    _written.append((spark, path))
    return path


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffled join); df is materialised."""
    return F.broadcast(df) if df.count() <= rows else df


def quoted(columns: list[str]) -> list[Column]:
    """The named columns as they are, dots and backticks in their names too."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def without(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in the one column of ``ids``, all columns in their order."""
    gone = small(ids.toDF("__gone"))
    return df.join(gone, df[key] == gone["__gone"], "left_anti")


def release(*frames: DataFrame) -> None:
    """Delete the files of tables that ``durable`` made, once no plan that is still to run reads them."""
    for df in frames:
        path = _paths.pop(id(df), None)
        if path:
            _delete(df.sparkSession, path)


def mark() -> int:
    """A point in time for ``sweep``."""
    return len(_written)


def sweep(since: int, *keep: DataFrame) -> None:
    """Delete the files of all tables that ``durable`` has made since a ``mark``, but for ``keep``; nothing that is still to
    run may read them."""
    kept = {_paths.get(id(df)) for df in keep}
    for spark, path in _written[since:]:
        if path not in kept:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may already be gone; the folder is scratch space
            return


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(node, label)``, label = the smallest node of the component.

    Alternating large-star and small-star contraction; each round is written to the shared folder.  Rounds stop
    when the edge set no longer changes (a handful of rounds: each at least halves the depth of what is left).
    Self loops and repeated edges are allowed.  No edges give no rows.  Each node's least neighbour is written before it is
    joined: a hub of very many edges is then broadcast to, or split by adaptive execution, and is no task of its own.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = durable(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(small(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large, "edges")
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        star = large.join(small(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(e, low, large, least)
        e = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    label = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())
