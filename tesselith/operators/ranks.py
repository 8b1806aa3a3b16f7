"""Ranks in hash order for groups of any size."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, by: list[str], order: Column, key: str, name: str) -> DataFrame:
    """``df`` with the 1-based rank of every row in its group by ``order`` (a hex hash) and ``key``.

    A group is ranked in 256 pieces by the first two digits of the hash; counts of the pieces give the ranks at
    which they begin. So no task sorts a whole group, however hot. Nulls in ``by`` are a group of their own.
    """
    rows = df.withColumn("_h", order).withColumn("_piece", F.substring("_h", 1, 2))
    counts = rows.groupBy(*by, "_piece").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_piece"))
    begins = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_piece").alias("_p"), (upto - F.col("_n")).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [F.col("_piece") == F.col("_p")]
    inside = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy("_h", key))
    return rows.withColumn("_in", inside).join(begins, functools.reduce(operator.and_, same)).select(*df.columns, (F.col("_before") + F.col("_in")).cast("bigint").alias(name))
