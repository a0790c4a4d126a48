"""A session with the settings that the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quarry", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew handling, and Arrow; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
