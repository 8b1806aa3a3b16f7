"""Samples, folds and splits. Every random order is a hash of seed and key, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.operators.passages import by_hash
from tesselith.operators.ranks import hash_rank
from tesselith.plans.sizing import small


def stratified_sample(df: DataFrame, n: int, strata: list[str], key: str, seed: str) -> DataFrame:
    """At most ``n`` rows: a floor of max(1, n // (3 * strata)) from every stratum, the rest in hash order."""
    h = by_hash(seed, key)
    count = df.select(*strata).distinct().agg(F.count("*").alias("k"))
    ranked = hash_rank(df, strata, h, key, "_r").withColumn("_h", h)
    ranked = ranked.crossJoin(F.broadcast(count)).withColumn("_first", F.col("_r") <= F.greatest(F.lit(1), F.floor(F.lit(n) / (3 * F.col("k")))))
    return ranked.orderBy(F.desc("_first"), "_h", key).limit(n).drop("_h", "_r", "k", "_first")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: str, name: str = "fold") -> DataFrame:
    """Folds that share every label value evenly; rows with a null label are a value of their own."""
    return hash_rank(df, [label], by_hash(seed, key), key, "_r").withColumn(name, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def document_folds(df: DataFrame, group: str, doc: str, k: int, seed: str, name: str = "fold") -> DataFrame:
    """Folds of whole documents, dealt in turn inside every group."""
    docs = df.select(group, doc).distinct()
    w = Window.partitionBy(group).orderBy(by_hash(seed, doc), doc)
    return df.join(docs.withColumn(name, ((F.row_number().over(w) - 1) % k).cast("int")), [group, doc])


def value_document_folds(df: DataFrame, label: str, doc: str, k: int, seed: str, name: str = "fold") -> DataFrame:
    """Folds of whole documents dealt inside every label value; a document with several values takes the last value's fold."""
    pairs = df.where(F.col(label).isNotNull()).select(label, doc).distinct()
    w = Window.partitionBy(label).orderBy(by_hash(seed, label, doc), doc)
    dealt = pairs.withColumn(name, ((F.row_number().over(w) - 1) % k).cast("int"))
    return df.join(dealt.groupBy(doc).agg(F.max_by(name, label).alias(name)), doc)


def even_chunks(df: DataFrame, key: str, k: int, seed: str, *by: str, name: str = "fold") -> DataFrame:
    """Keys in hash order cut into ``k`` chunks of even size."""
    ids = df.select(*by, key).distinct().withColumn("_all", F.lit(1))
    ranked = hash_rank(ids, [*by, "_all"], by_hash(seed, key), key, "_r")
    sizes = ids.groupBy(*by, "_all").agg(F.count("*").alias("_n"))
    # The first n % k chunks hold one more, as ntile does.
    each, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    cut = extra * (each + 1)
    chunk = F.when(F.col("_r") <= cut, F.floor((F.col("_r") - 1) / (each + 1))).otherwise(extra + F.floor((F.col("_r") - 1 - cut) / F.greatest(each, F.lit(1))))
    dealt = ranked.join(F.broadcast(sizes) if not by else sizes, [*by, "_all"]).select(*by, key, chunk.cast("int").alias(name))
    return df.join(dealt, [*by, key])


def regimes(df: DataFrame, group: str, doc: str, key: str, fraction: float, seed: str, least: int = 5, held_out: list[str] | None = None) -> DataFrame:
    """Rows for each group ``held`` out: whether a row is tested, and three columns that tell which training set holds it.

    random: any row that is no test row; doc: no row of a test document; group: no row of the group. The first two
    are cut, in hash order, to the size of the third. Every group is held out in turn, or those of ``held_out``.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col(group).isNotNull())
    held = sizes.select(F.col(group).alias("held"), F.col("_n").alias("_size"))
    if held_out is not None:
        held = held.where(F.col("held").isin(held_out))
    n_all = df.count()
    ranked = hash_rank(df, [group], by_hash(seed, key), key, "_r")
    rows = ranked.crossJoin(small(held))  # an experiment of its own for each group
    mine = F.col(group).eqNullSafe(F.col("held"))
    rows = rows.withColumn("test", mine & (F.col("_r") <= F.greatest(F.lit(least), F.round(F.col("_size") * fraction)))).withColumn("_n", n_all - F.col("_size")).drop("_r", "_size")
    test_docs = rows.where("test").select("held", doc).distinct().withColumn("_t", F.lit(True))
    rows = rows.join(test_docs, ["held", doc], "left").withColumn("_doc", ~F.col("test") & F.col("_t").isNull()).withColumn("_random", ~F.col("test")).withColumn("train_group", ~mine)
    order = by_hash(seed + "-train", key)
    for name in ("random", "doc"):
        rows = hash_rank(rows, ["held", f"_{name}"], order, key, f"_k{name}")
    return rows.select("held", *df.columns, "test", *[(F.col(f"_{x}") & (F.col(f"_k{x}") <= F.col("_n"))).alias(f"train_{x}") for x in ("random", "doc")], "train_group")


def matched_folds(df: DataFrame, label: str, doc_fold: str, key: str, k: int, seed: str, name: str = "fold") -> DataFrame:
    """Folds of rows, and for every fold (column ``doc_fold``) a training set as large as the one that whole documents leave: (rows, ``name``, ``train_<f>``)."""
    rows = stratified_folds(df, label, key, k, seed, name)
    sizes = {r[0]: r[1] for r in df.groupBy(doc_fold).count().collect()}  # a row for each fold
    n = sum(sizes.values())
    for f in range(k):
        inside = rows.withColumn("_out", F.col(name) != f)
        rows = hash_rank(inside, ["_out"], by_hash(f"{seed}-{f}", key), key, "_k").withColumn(f"train_{f}", F.col("_out") & (F.col("_k") <= n - sizes.get(f, 0))).drop("_out", "_k")
    return rows


def unseen(df: DataFrame, label: str, fold: str) -> DataFrame:
    """(fold, n): values of ``label`` that stand in one fold alone, so that the other folds cannot teach them."""
    seen = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(fold).alias("_a"), F.max(fold).alias("_b")).where("_a = _b")
    return seen.groupBy(F.col("_a").alias("fold")).agg(F.count("*").alias("n"))


def retried_folds(df: DataFrame, label: str, doc: str, k: int, seed: str, tries: int = 20) -> tuple[DataFrame, int]:
    """Document folds by label value, dealt anew (at most ``tries`` times) until no value stands in one fold alone; the folds and the number of the try."""
    for t in range(tries):
        got = value_document_folds(df, label, doc, k, f"{seed}-{t}")
        if not unseen(got, label, "fold").limit(1).count():
            break
    return got, t


def fold_count(k: int) -> int:
    """Folds for ``k`` documents a value."""
    return min(4, k)


def deepest_dose(df: DataFrame, value: str, doc: str, rows: int, values: int = 4, most: int = 20) -> tuple[int, DataFrame]:
    """(the largest number of documents that ``values`` values have, documents counting from ``rows`` rows on; the ``most`` values with most documents)."""
    docs = df.groupBy(value, doc).agg(F.count("*").alias("_n")).where(F.col("_n") >= rows).groupBy(value).agg(F.count("*").alias("n_docs"))
    first = docs.orderBy(F.desc("n_docs"), value).limit(most)
    top = [r.n_docs for r in first.limit(values).collect()]
    return (top[-1] if len(top) == values else 0), first


def dose_draw(df: DataFrame, value: str, doc: str, key: str, m: int, target: int, seed: str) -> DataFrame:
    """``target`` rows per value from exactly ``m`` documents with at least ceil(target / m) rows each.

    Values that have too few such documents or rows are left out.
    """
    need = -(-target // m)
    docs = df.groupBy(value, doc).agg(F.count("*").alias("_n")).where(F.col("_n") >= need)
    docs = docs.withColumn("_r", F.row_number().over(Window.partitionBy(value).orderBy(by_hash(seed, value, doc), doc))).where(F.col("_r") <= m)
    rows = df.join(docs.select(value, doc), [value, doc])
    rows = hash_rank(rows, [value, doc], by_hash(seed, key), key, "_k").where(F.col("_k") <= need)
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(value).orderBy("_k", by_hash(seed, key), key))).where(F.col("_k") <= target)
    whole = rows.groupBy(value).agg(F.count("*").alias("_n"), F.count_distinct(doc).alias("_d")).where((F.col("_n") == target) & (F.col("_d") == m)).select(value)
    return rows.drop("_k").join(whole, value, "left_semi")


def pool_draw(df: DataFrame, value: str, doc: str, key: str, k: int, total: int, seed: str) -> DataFrame:
    """``k`` documents per value in hash order, then at most ``total`` of their rows."""
    docs = df.select(value, doc).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(value).orderBy(by_hash(seed, value, doc), doc))).where(F.col("_r") <= k)
    rows = df.join(docs.select(value, doc), [value, doc])
    return hash_rank(rows, [value], by_hash(seed, key), key, "_r").where(F.col("_r") <= total).drop("_r")


def equal_draws(df: DataFrame, by: list[str], key: str, n: int, reps: int, seed: str) -> DataFrame:
    """``reps`` subsamples without replacement of ``n`` rows of every cell; rows with ``rep``."""
    r = df.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep"))
    rows = df.crossJoin(F.broadcast(r))  # reps is a parameter
    first = Window.partitionBy("rep", *by).orderBy(by_hash(seed, "rep", key), key)  # only the first n of a partition's part of a cell are shuffled
    return rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= n).drop("_k")


def review_queue(df: DataFrame, key: str, suggestion: Column, shown: float, repeats: int, gap: int, seed: str) -> DataFrame:
    """(i, key, suggested, repeat_of): every row once in hash order, its suggestion shown with the given share, and blind repeats at least ``gap`` places later."""
    part = F.conv(F.substring(by_hash(seed + "-shown", key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    once = df.select(F.col(key).alias("key"), F.when(part < shown, suggestion).alias("suggested"), F.lit(1).alias("_all"))
    ranked = hash_rank(once, ["_all"], by_hash(seed, "key"), "key", "_i")
    total = once.agg(F.count("*").alias("_n"))
    before = F.least(F.greatest(F.col("_i") - gap - 1, F.lit(0)), F.lit(repeats))  # repeats shown earlier
    shown_once = ranked.select((F.col("_i") - 1 + before).alias("i"), "key", "suggested", F.lit(None).cast("string").alias("repeat_of"))
    again = ranked.where(F.col("_i") <= repeats).crossJoin(F.broadcast(total))  # one row
    again = again.select((F.least(F.col("_n"), F.col("_i") + gap) + F.col("_i") - 1).alias("i"), "key", F.lit(None).cast("string").alias("suggested"), F.col("key").alias("repeat_of"))
    return shown_once.unionByName(again)
