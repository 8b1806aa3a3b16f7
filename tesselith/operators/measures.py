"""Agreement, information and error measures from counts; every one is a few aggregates over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.operators.passages import by_hash
from tesselith.operators.ranks import hash_rank


def confusion(df: DataFrame, truth: str, pred: str, *by: str) -> DataFrame:
    """(by, t, p, n): counts of pairs; rows without either value are left out."""
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def per_value_f1(counts: DataFrame, *by: str) -> DataFrame:
    """(by, label, tp, fp, fn, f1) over the labels that occur as truth or prediction."""
    tp = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    miss = F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    a = counts.select(*by, F.col("t").alias("label"), tp.cast("bigint").alias("tp"), zero.alias("fp"), miss.cast("bigint").alias("fn"))
    b = counts.select(*by, F.col("p").alias("label"), zero.alias("tp"), miss.cast("bigint").alias("fp"), zero.alias("fn"))
    s = a.unionByName(b).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_f1(counts: DataFrame, *by: str) -> DataFrame:
    """(by, macro_f1, accuracy, n)."""
    f1 = per_value_f1(counts, *by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    acc = counts.groupBy(*by).agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    return f1.join(acc, list(by)) if by else f1.crossJoin(F.broadcast(acc))  # one row each


def kappa(counts: DataFrame) -> DataFrame:
    """(n, observed, expected, kappa) of two coders; 1 where chance agreement is certain."""
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("same"))
    r = counts.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("r"))
    c = counts.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("c"))
    chance = r.join(c, "label").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("rc"))
    out = total.crossJoin(F.broadcast(chance)).select(F.col("total").alias("n"), (F.col("same") / F.col("total")).alias("observed"), (F.col("rc") / F.col("total") / F.col("total")).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") >= 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def alpha(counts: DataFrame) -> DataFrame:
    """(n, alpha): Krippendorff's nominal alpha of two coders; null without pairs, 1 where no disagreement can be expected."""
    both = counts.select(F.col("t").alias("v"), "n").unionAll(counts.select("p", "n")).groupBy("v").agg(F.sum("n").alias("m"))
    e = both.agg(F.sum("m").alias("m"), F.sum(F.col("m") * (F.col("m") - 1)).alias("mm"))
    o = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0)).alias("differ"))
    chance = 1 - F.col("mm") / (F.col("m") * (F.col("m") - 1))
    return o.crossJoin(F.broadcast(e)).select("n", F.when(chance == 0, 1.0).otherwise(1 - (F.col("differ") / F.col("n")) / chance).alias("alpha"))


def entropy(counts: Column) -> Column:
    """Entropy (natural) of a group's counts, as an aggregate."""
    return F.log(F.sum(counts)) - F.sum(counts * F.log(counts)) / F.sum(counts)


def theil_u(df: DataFrame, group: str, label: str) -> DataFrame:
    """(h_label, h_given, u): the share of a label's entropy that the group fixes; 0 for a constant label."""
    c = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(group).alias("g"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    hl = c.groupBy("l").agg(F.sum("n").alias("n")).agg(entropy(F.col("n")).alias("h_label"))
    hg = c.groupBy("g").agg(entropy(F.col("n")).alias("h"), F.sum("n").alias("m")).agg((F.sum(F.col("h") * F.col("m")) / F.sum("m")).alias("h_given"))
    return hl.crossJoin(F.broadcast(hg)).withColumn("u", F.when(F.col("h_label") == 0, 0.0).otherwise((F.col("h_label") - F.col("h_given")) / F.col("h_label")))


def theil_u_null(df: DataFrame, group: str, label: str, key: str, reps: int, seed: str) -> DataFrame:
    """(rep, u): Theil's U with the labels dealt anew to the rows, each replicate by its own hash order."""
    rows = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(group).alias("g"), F.col(label).alias("l"))
    rep = df.sparkSession.range(reps).select(F.col("id").alias("rep"))
    many = rows.crossJoin(F.broadcast(rep))  # reps is a parameter
    dealt = hash_rank(many, ["rep"], by_hash(seed, "rep", "_key"), "_key", "_k").select("rep", "_k", "g")
    plain = hash_rank(rows.withColumn("_all", F.lit(1)), ["_all"], by_hash(seed, "_key"), "_key", "_k").select("_k", "l")
    c = dealt.join(plain, "_k").groupBy("rep", "g", "l").agg(F.count("*").alias("n"))
    hl = c.groupBy("rep", "l").agg(F.sum("n").alias("n")).groupBy("rep").agg(entropy(F.col("n")).alias("h_label"))
    hg = c.groupBy("rep", "g").agg(entropy(F.col("n")).alias("h"), F.sum("n").alias("m")).groupBy("rep").agg((F.sum(F.col("h") * F.col("m")) / F.sum("m")).alias("h_given"))
    return hl.join(hg, "rep").select("rep", F.when(F.col("h_label") == 0, 0.0).otherwise((F.col("h_label") - F.col("h_given")) / F.col("h_label")).alias("u"))


def theil_u_adjusted(df: DataFrame, group: str, label: str, key: str, reps: int, seed: str) -> DataFrame:
    """(u, null, adjusted, p): U, its mean under permutations, what is left of it, and how often a permutation reaches it."""
    real = theil_u(df, group, label).select(F.col("u").alias("_u"))
    n = theil_u_null(df, group, label, key, reps, seed).crossJoin(F.broadcast(real))  # one row
    out = n.agg(F.first("_u").alias("u"), F.avg("u").alias("null"), ((1 + F.count_if(F.col("u") >= F.col("_u") - 1e-12)) / (1 + F.count("*"))).alias("p"))
    return out.select("u", "null", F.when(F.col("null") < 1, (F.col("u") - F.col("null")) / (1 - F.col("null"))).otherwise(F.col("u")).alias("adjusted"), "p")


def smoothed(df: DataFrame, by: list[str], label: str, vocabulary: list[str]) -> DataFrame:
    """(by, label, q): distribution over a fixed vocabulary with half a count added to each value."""
    words = df.sparkSession.createDataFrame([(v,) for v in vocabulary], "label string")
    c = df.where(F.col(label).isin(vocabulary)).groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    grid = c.select(*by).distinct().crossJoin(F.broadcast(words))
    full = grid.join(c, [*by, "label"], "left").select(*by, "label", (F.coalesce("n", F.lit(0)) + 0.5).alias("v"))
    return full.withColumn("q", F.col("v") / F.sum("v").over(Window.partitionBy(*by))).drop("v")


def jsd(dist: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, a, b, jsd): Jensen-Shannon divergence (bits) of every pair of keys a < b of the distributions; a distribution is one row before rows are paired."""
    rows = dist.groupBy(*by, key).agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "q"))), lambda x: x["q"]).alias("_q"))  # as long as the vocabulary
    x, y = rows.select(*by, F.col(key).alias("a"), F.col("_q").alias("_p")), rows.select(*by, F.col(key).alias("b"), "_q")
    part = lambda p, q: 0.5 * p * F.log2(p / ((p + q) / 2)) + 0.5 * q * F.log2(q / ((p + q) / 2))
    pairs = x.join(y, (F.col("a") < F.col("b")) if not by else [*by]).where("a < b")
    return pairs.select(*by, "a", "b", F.aggregate(F.zip_with("_p", "_q", part), F.lit(0.0), lambda s, v: s + v).alias("jsd"))


def average_rank(value: str, *by: str) -> Column:
    """1-based rank inside groups of bounded size; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def average_ranks(df: DataFrame, value: str, name: str, pieces: int = 64) -> DataFrame:
    """``df`` with the 1-based rank ``name`` of its value among all rows, ties sharing the mean; null values have none.

    Values are counted first and cut into pieces at rough quantiles, so no task sorts all of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    cuts = sorted(set(df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / pieces for i in range(1, pieces)], 0.01)))
    piece = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    counts = counts.withColumn("_p", piece)
    before = counts.groupBy("_p").agg(F.sum("_c").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each piece
    inside = F.sum("_c").over(Window.partitionBy("_p").orderBy(value)) - F.col("_c")
    ranked = counts.withColumn("_i", inside).join(before.select("_p", "_b"), "_p").select(value, (F.col("_b") + F.col("_i") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranked, value, "left")


def log_odds(counts: DataFrame, group: str, term: str, a0: float = 500.0, least: int = 5) -> DataFrame:
    """(group, term, n, z): log-odds with a Dirichlet prior, from counts (group, term, n)."""
    per_term = counts.groupBy(term).agg(F.sum("n").alias("n_term")).where(F.col("n_term") >= least)
    per_group = counts.groupBy(group).agg(F.sum("n").alias("n_grp"))
    total = counts.agg(F.sum("n").alias("n_all"))
    d = counts.join(per_term, term).join(per_group, group).crossJoin(F.broadcast(total))
    aw = F.lit(a0) * F.col("n_term") / F.col("n_all")
    rest, n_rest = F.col("n_term") - F.col("n"), F.col("n_all") - F.col("n_grp")
    left = F.log((F.col("n") + aw) / (F.col("n_grp") + a0 - F.col("n") - aw))
    right = F.log((rest + aw) / (n_rest + a0 - rest - aw))
    return d.select(group, term, "n", ((left - right) / F.sqrt(1 / (F.col("n") + aw) + 1 / (rest + aw))).alias("z"))
