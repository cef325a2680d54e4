"""The Spark session that the engine expects: UTC, adaptive execution on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "popspark", **more: str) -> SparkSession:
    """A session with SETTINGS; keyword arguments use _ for the dots of their keys."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
