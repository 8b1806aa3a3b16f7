"""Settings of a session; a cluster's own settings come first."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine for tests and benches."""
    n = cpus or os.cpu_count() or 4
    b = SparkSession.builder.master(f"local[{n}]").appName("tesselith").config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(n), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
