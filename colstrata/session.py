"""Spark sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI errors instead of silent wrap-around, UTC timestamps, adaptive execution; the rest is the cluster's business.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; ``master`` only for local use, ``settings`` with underscores for dots."""
    builder = SparkSession.builder.appName("colstrata")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
