"""Term counts and TF-IDF vectors as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions.text import blank
from tesselith.plans.lineage import materialise


def term_counts(df: DataFrame, by: str, text: str, pattern: str) -> DataFrame:
    """(by, term, n): how often each term (a match of ``pattern`` in the lower-cased text) occurs."""
    terms = F.explode(F.regexp_extract_all(F.lower(blank(F.col(text))), F.lit(f"({pattern})"), 1)).alias("term")
    return df.select(by, terms).groupBy(by, "term").agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group; Spark keeps only k a partition before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def grams(df: DataFrame, key: str, text: str, without: list[str] | None = None) -> DataFrame:
    """(key, term, tf): words of two or more characters and their bigrams, counted inside the row; words of ``without`` are left out first."""
    words = F.regexp_extract_all(F.lower(blank(F.col(text))), F.lit(r"([a-z0-9_]{2,})"), 1)
    if without:
        words = F.filter(words, lambda w: ~w.isin(without))

    def both(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
        return F.concat(w, pairs)

    terms = F.get(F.transform(F.array(words), both), F.lit(0))
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, key: str, text: str, min_df: int = 2, n_docs: int | None = None) -> DataFrame:
    """(key, term, weight, norm): sublinear tf times smoothed idf, scaled to length 1; ``norm`` is the length before. Texts without terms have no row."""
    c = materialise(grams(df, key, text), "grams")
    n = df.count() if n_docs is None else n_docs
    k = c.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    w = c.join(k, "term").select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # a text's terms; one exchange instead of an aggregate and a join
    return w.withColumn("norm", norm).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"), "norm")
