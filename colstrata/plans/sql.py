"""SQL entry point over named arrays, DataFrames and paths."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources import from_list, from_numpy, load_csv

READ_ONLY = re.compile(r"^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(select|with|values|table|from|\()", re.I | re.S)


class NotSupported(ValueError):
    """The statement would change data."""


def execute(spark: SparkSession, sql: str, data: dict | None = None, args: dict | list | None = None) -> DataFrame:
    """The result of a query; ``data`` names the tables: DataFrames, arrays or lists (one column ``x`` beside
    ``row_idx``), or paths of Parquet or CSV files.  ``args`` are bound as parameters.  Other statements than queries are
    rejected; Catalyst plans the rest.  Names are visible to this query only."""
    if not READ_ONLY.match(sql):
        raise NotSupported("only queries are supported")
    return _named(spark, sql, data, args) if data else spark.sql(sql, args=args) if args else spark.sql(sql)


def _named(spark: SparkSession, sql: str, data: dict, args) -> DataFrame:
    views = {}
    for name, value in data.items():
        table(spark, value).createOrReplaceTempView(f"_in_{name}")
        views[name] = f"_in_{name}"
    try:
        bound = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        body = re.sub(r"^\s*with\s+(recursive\s+)?", lambda m: f"WITH {m[1] or ''}{bound}, ", sql, count=1, flags=re.I) if re.match(r"\s*with\b", sql, re.I) else f"WITH {bound} {sql}"
        return spark.sql(body, args=args) if args else spark.sql(body)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def table(spark: SparkSession, value) -> DataFrame:
    """A table of a DataFrame, an array, a list, or a path."""
    if isinstance(value, DataFrame):
        return value
    if isinstance(value, np.ndarray):
        return from_numpy(spark, value)
    if isinstance(value, list | tuple):
        return from_list(spark, list(value))
    if isinstance(value, str):
        return load_csv(spark, value) if value.endswith(".csv") else spark.read.parquet(value)
    raise TypeError(f"no table of {type(value).__name__}")
