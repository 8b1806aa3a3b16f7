"""Pools of passages from outside tables, masks built from lexicons, conditions of one data set, and checks between sets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators.passages import by_hash


def adapted(df: DataFrame, label: Column, doc: Column, text: Column) -> DataFrame:
    """(label, doc_id, text) of any outside table; rows that lack one of them are left out."""
    return df.select(label.cast("string").alias("label"), doc.cast("string").alias("doc_id"), text.alias("text")).where("label is not null and doc_id is not null and text is not null and trim(text) <> ''")


def first_field(json: Column, *paths: str) -> Column:
    """The first of several JSON fields that is there and not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, p)), F.lit("")) for p in paths])


def quota(pool: DataFrame, per_value: int, seed: str) -> DataFrame:
    """The passages of ``per_value`` documents of each label, in hash order: the quota is the operator's purpose."""
    docs = pool.select("label", "doc_id").distinct()
    w = Window.partitionBy("label").orderBy(by_hash(seed, "label", "doc_id"), "doc_id")
    kept = docs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_value).drop("_k")
    return pool.join(kept, ["label", "doc_id"], "left_semi")


def lexicon_mask(c: Column, words: list[str], mark: str = "§LEX", least: int = 4) -> Column:
    """Words of a lexicon of at least ``least`` letters as a mark, longest first, case aside."""
    return T.mask_terms(c, sorted({w for w in words if len(w) >= least and re.fullmatch(r"[A-Za-z]+", w)}), mark)


def place_mask(c: Column, names: list[str]) -> Column:
    """Names of places, citations, sections and numbers as marks."""
    return T.mask_numbers(T.mask_terms(c, names, "§PLACE"))


def conditions(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """``df`` once for every named condition that a row meets, with the name as ``condition``; one scan serves all."""
    met = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    return df.withColumn("condition", F.explode(met))


def without(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose value is in no exclusion set; nulls stay."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(values))


def on_common_keys(key: str, *metrics: DataFrame) -> DataFrame:
    """Metrics (key, ...) side by side for the keys that all of them have."""
    return reduce(lambda a, b: a.join(b, key), metrics)


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(n): values of ``column`` that both sets hold, 0 for sets that are kept apart."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi").agg(F.count("*").alias("n"))


def page_slices(df: DataFrame, key: str, text: str, labels: list[str]) -> DataFrame:
    """(key, label, part): what stands after each label of a page up to the next one; a label is a line of its own, with or without a colon."""
    names = "|".join(re.escape(x) for x in labels)
    parts = df.select(key, F.explode(F.split(F.concat(F.lit("\n"), T.blank(F.col(text))), rf"(?i)\n(?=[ \t]*(?:{names})[ \t]*:?[ \t]*(?:\n|$))")).alias("p"))
    label = F.regexp_extract("p", rf"(?i)^[ \t]*({names})[ \t]*:?[ \t]*(?:\n|$)", 1)
    return parts.select(key, F.lower(label).alias("label"), T.strip(F.regexp_replace("p", r"^[^\n]*\n?", "")).alias("part")).where("label <> ''")
