"""Session construction with the settings every query relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "quiescent", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer on."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
