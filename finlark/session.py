"""Sessions as the engine wants them: UTC, adaptive plans, ANSI left on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "finlark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
