"""The queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselith.plans import q_annotation, q_models, q_passages, q_segments, q_splits, q_statistics, q_streams, q_structure

MODULES = (q_passages, q_segments, q_annotation, q_structure, q_splits, q_statistics, q_streams, q_models)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
