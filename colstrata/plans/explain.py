"""Plans as text, facts about them for tests, and run metrics."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def plan(df: DataFrame, mode: str = "formatted") -> str:
    """The explained plan as a string."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def pushed_filters(df: DataFrame) -> list[str]:
    return [x.strip() for m in re.findall(r"PushedFilters: \[(.*?)\]", plan(df)) for x in re.findall(r"\w+\([^()]*\)", m)]


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read."""
    return sorted({c.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*?)>\n", plan(df) + "\n") for c in m.split(",") if c})


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan."""
    return len(re.findall(r"^\(\d+\) Exchange", plan(df), re.M))


def has_python(df: DataFrame) -> bool:
    return bool(re.search(r"Python|Pandas|Arrow", plan(df)))


#: What Spark counts in a plan, by the names of its metrics.
COUNTED = {"bytes_read": ("size of files read",), "shuffle_bytes": ("shuffle bytes written",), "spill_bytes": ("spill size",)}


def metrics(df: DataFrame, name: str = "query") -> DataFrame:
    """Run ``df`` to nothing and return ``(name, rows, seconds, tasks, bytes_read, shuffle_bytes, spill_bytes)``."""
    spark = df.sparkSession
    group = f"metrics-{uuid.uuid4().hex}"
    seen, context = Observation(), spark.sparkContext
    context.setJobGroup(group, name)
    began = time.perf_counter()
    run = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    run.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    tracker = context.statusTracker()
    tasks = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        stages = [tracker.getStageInfo(s) for s in (info.stageIds if info else [])]
        tasks += sum(s.numTasks for s in stages if s)
    context._jsc.clearJobGroup()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values = {x.accumulatorId(): x.name() for x in _each(last.metrics())}
    found = store.executionMetrics(last.executionId())
    sums = {k: 0 for k in COUNTED}
    for at, label in values.items():
        for k, labels in COUNTED.items():
            if label in labels and found.contains(at):
                sums[k] += _bytes(found.apply(at))
    row = (name, seen.get["rows"], took, tasks, *sums.values())
    return spark.createDataFrame([row], "name string, rows long, seconds double, tasks long, bytes_read long, shuffle_bytes long, spill_bytes long")


def _each(seq):
    for i in range(seq.size()):
        yield seq.apply(i)


def _bytes(text: str) -> int:
    """The first size in a metric's text, such as ``12.5 MiB`` or a total over its tasks."""
    m = re.search(r"([\d.,]+) (B|KiB|MiB|GiB|TiB)", text)
    return int(float(m[1].replace(",", "")) * 1024 ** ["B", "KiB", "MiB", "GiB", "TiB"].index(m[2])) if m else 0
