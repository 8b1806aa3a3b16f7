"""Passages: scans, filters, first-wins choice, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.sources.tables import table


def passages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row for each provision with its group key ``grp`` and the named columns; a row delivered twice counts once.

    The exchange by key has a fixed number of partitions: the work on texts that follows is far more than their
    bytes suggest, so it must not be coalesced into few tasks. Later steps by the key need no other exchange.
    """
    wanted = list(dict.fromkeys(["provision_id", *columns]))
    rows = table(spark, sf_dir, "corpus").select(*dict.fromkeys([*wanted, "nation"]))
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "provision_id")
    return rows.dropDuplicates(["provision_id"]).select(*wanted, T.group_key(F.col("nation")).alias("grp"))


def by_hash(seed: str, *keys: str | Column) -> Column:
    """An order that depends on seed and keys only; every engine has it."""
    return F.md5(F.concat_ws("|", F.lit(seed), *keys))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key. Null keys are a key of their own; ``order`` must be total for a fixed result."""
    cols = df.columns
    first = F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")  # an aggregate, so hot keys combine before the shuffle
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first).select("_r.*")


def keep_groups(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows; counts are aggregated first and joined back."""
    sizes = df.groupBy(key).count().where(F.col("count") >= least).select(key)
    return df.join(sizes, key, "left_semi")


def top(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent values; ties go to the smaller key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def islands(lines: DataFrame, doc: str, pos: str, flag: str, blank: str, least: int) -> DataFrame:
    """``lines`` with ``drop``: true inside runs of flagged (or blank) lines that begin at a flagged line and hold at least ``least`` flags."""
    w = Window.partitionBy(doc).orderBy(pos)
    run = F.sum(F.when(F.col(flag) | F.col(blank), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("_run", run)
    whole = Window.partitionBy(doc, "_run")
    inside = F.col(flag) | F.col(blank)
    first = F.min(F.when(F.col(flag), F.col(pos))).over(whole)
    return marked.withColumn("drop", inside & (F.col(pos) >= first) & (F.sum(F.col(flag).cast("int")).over(whole) >= least)).withColumn("drop", F.coalesce("drop", F.lit(False))).drop("_run")


def lines_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line) of every line; null texts have none."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def heading_stack(events: DataFrame, doc: str, pos: str, level: str, label: str, n_levels: int = 4) -> DataFrame:
    """As-of headings: at every row the label in force at each level, a heading clearing all deeper levels.

    ``events`` holds headings (level and label set) and sections (level null) by place; adds ``path`` and ``deepest``.
    """
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = events
    for k in range(n_levels):
        at = F.col(level) == k
        out = out.withColumn(f"_p{k}", F.max(F.when(at, F.col(pos))).over(w)).withColumn(f"_l{k}", F.last(F.when(at, F.col(label)), ignorenulls=True).over(w))
    live = []
    for k in range(n_levels):
        cleared = [F.coalesce(F.col(f"_p{j}"), F.lit(-1)) > F.col(f"_p{k}") for j in range(k)]
        ok = F.col(f"_p{k}").isNotNull()
        for c in cleared:
            ok = ok & ~c
        live.append(F.when(ok, F.col(f"_l{k}")))
    path = F.concat_ws(" > ", *live)
    deepest = F.coalesce(*reversed(live))
    return out.withColumn("path", path).withColumn("deepest", F.coalesce(deepest, F.lit(""))).drop(*[f"_{c}{k}" for c in "pl" for k in range(n_levels)])


def dominant_name(df: DataFrame, key: str, text: Column, names: DataFrame, name: str, least: int, times: int) -> DataFrame:
    """(key, name, hits): the name whose first word stands most often in ``text``, at least ``least`` times and ``times`` as often as the next one.

    Words are counted in each text first and joined with the first words of ``names``; of names with one first word the smaller counts.
    """
    first = names.groupBy(F.regexp_extract(name, "[a-z]+", 0).alias("_w")).agg(F.min(name).alias("name"))
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(T.blank(text)), F.lit("([a-z]+)"), 1)).alias("_w"))
    hits = words.join(first, "_w").groupBy(key, "name").agg(F.count("*").alias("hits"))
    w = Window.partitionBy(key).orderBy(F.desc("hits"), "name")
    ranked = hits.withColumn("_k", F.row_number().over(w)).withColumn("_second", F.coalesce(F.lead("hits").over(w), F.lit(0)))
    return ranked.where((F.col("_k") == 1) & (F.col("hits") >= least) & (F.col("hits") >= times * F.col("_second"))).select(key, "name", "hits")


def word_windows(df: DataFrame, key: str, text: str, size: int = 60) -> DataFrame:
    """(key, k, passage): windows of ``size`` words, the last partial one left out."""
    words = F.split(T.squash(T.blank(F.col(text))), " ")
    n = F.floor(F.size(words) / size).cast("int")
    rows = df.select(key, words.alias("_w"), n.alias("_n")).where("_n > 0").select(key, "_w", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k"))
    return rows.select(key, "k", F.array_join(F.slice("_w", F.col("k") * size + 1, size), " ").alias("passage"))
