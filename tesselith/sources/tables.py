"""Scans of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; filters and columns are pushed to the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
