"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselith.llm import grouping, mixing, neardup, proportions, related_splits, residue, scan_noise, split_overlap, subjects, tokenizer

MODULES = (proportions, grouping, related_splits, tokenizer, mixing, neardup, split_overlap, residue, scan_noise, subjects)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All functions named pN_..."""
    return {name: f for m in MODULES for name, f in vars(m).items() if name[0] == "p" and name[1:].split("_")[0].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
