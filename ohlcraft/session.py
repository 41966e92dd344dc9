"""Session builder used by the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "ohlcraft", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", os.environ.get("OHLCRAFT_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # call-site capture for every Column costs more than planning the query
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
