"""Resampling and exact tests. Draws come from hashes, so they are the same on every cluster."""

from __future__ import annotations

import functools
import itertools
import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.operators import measures as M
from tesselith.operators.passages import by_hash
from tesselith.operators.ranks import hash_rank
from tesselith.plans.sizing import small


def sign_flip_exact(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(n, mean, n_extreme, p): all 2^n sign patterns of the differences; p never falls under 2 / 2^n. For n up to 20."""
    d = diffs.select(F.col(key).alias("k"), F.col(diff).alias("d")).where("d is not null")
    n = d.limit(21).count()
    if n > 20:
        raise ValueError("the exact test enumerates 2^n patterns; use sign_flip for more than 20 groups")
    d = d.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("k")) - 1).alias("j"), "d")  # at most 20 rows
    total = d.agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    flips = d.sparkSession.range(1 << n).select(F.col("id").alias("i"))
    signed = F.when(F.expr("(shiftright(i, cast(j as int)) & 1) = 1"), F.col("d")).otherwise(-F.col("d"))
    sums = flips.crossJoin(F.broadcast(d)).groupBy("i").agg(F.sum(signed).alias("t"))  # at most 20 rows on the small side
    out = sums.crossJoin(F.broadcast(total)).agg(F.first("n").alias("n"), F.first("s").alias("s"), F.count_if(F.abs("t") >= F.abs("s") - 1e-12).alias("n_extreme"), F.count("*").alias("all"))
    return out.select("n", (F.col("s") / F.col("n")).alias("mean"), "n_extreme", F.greatest(F.col("n_extreme") / F.col("all"), 2 / F.col("all")).alias("p"))


def sign_flip_halves(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(n, mean, n_extreme, p) as ``sign_flip_exact``, for up to 40 groups: sums of the two halves, sorted, and counted against each other.

    Groups enter in the order of their key; the 2^n patterns are never listed, only 2^(n/2) sums of each half, on the driver.
    """
    d = [r.d for r in diffs.where(F.col(diff).isNotNull()).orderBy(key).select(F.col(diff).cast("double").alias("d")).limit(41).collect()]
    n = len(d)
    if n > 40:
        raise ValueError("the halves hold 2^(n/2) sums; use sign_flip for more than 40 groups")
    if not n:
        return diffs.sparkSession.createDataFrame([(0, None, 0, None)], "n bigint, mean double, n_extreme bigint, p double")

    def sums(part: list[float]) -> np.ndarray:
        out = np.zeros(1)
        for x in part:
            out = np.concatenate([out - x, out + x])
        return out

    one, two = sums(d[: n // 2]), np.sort(sums(d[n // 2 :]))
    least = abs(sum(d)) - 1e-12
    if least <= 0:
        extreme = 1 << n
    else:
        above = len(two) - np.searchsorted(two, least - one, "left")
        extreme = int(above.sum() + np.searchsorted(two, -least - one, "right").sum())
    p = max(extreme, 2) / (1 << n)
    return diffs.sparkSession.createDataFrame([(n, sum(d) / n, extreme, p)], "n bigint, mean double, n_extreme bigint, p double")


def sign_flip(diffs: DataFrame, key: str, diff: str, reps: int, seed: str) -> DataFrame:
    """(n, mean, p): random signs from hash bits; p = (1 + extreme) / (reps + 1)."""
    r = diffs.sparkSession.range(reps).select(F.col("id").alias("rep"))
    d = diffs.select(F.col(key).alias("k"), F.col(diff).alias("d")).where("d is not null")
    bit = F.substring(by_hash(seed, "rep", "k"), 1, 1) < "8"
    t = d.crossJoin(F.broadcast(r)).groupBy("rep").agg(F.sum(F.when(bit, F.col("d")).otherwise(-F.col("d"))).alias("t"))  # groups x reps
    s = d.agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(s)).agg(F.first("n").alias("n"), F.first(F.col("s") / F.col("n")).alias("mean"), ((1 + F.count_if(F.abs("t") >= F.abs("s") - 1e-12)) / (reps + 1)).alias("p"))


def draws(clusters: DataFrame, key: str, reps: int, seed: str) -> DataFrame:
    """(rep, key, m): how often each cluster is drawn with replacement in each replicate; rows with m = 0 are left out.

    Every draw is one row of a range, its cluster the one whose rank in hash order a hash of the draw names.
    """
    ids = clusters.select(F.col(key).alias("_id")).distinct().withColumn("_all", F.lit(1))
    ranked = hash_rank(ids, ["_all"], by_hash(seed, "_id"), "_id", "_r").select((F.col("_r") - 1).alias("j"), F.col("_id").alias(key))
    n = ids.count()
    slots = ids.sparkSession.range(reps * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), (F.col("id") % max(n, 1)).alias("slot"))
    pick = F.conv(F.substring(by_hash(seed, "rep", "slot"), 1, 12), 16, 10).cast("bigint") % max(n, 1)
    return slots.select("rep", pick.alias("j")).groupBy("rep", "j").agg(F.count("*").alias("m")).join(small(ranked), "j").select("rep", key, "m")


def _classed(spark, shares: list[tuple[str, float]], arms: int, n: int, reps: int, seed: str) -> DataFrame:
    """(rep, arm, label, c): ``n`` draws from fixed shares, a hash of rep, arm and draw as the random number."""
    ends = np.cumsum([q for _, q in shares])
    slots = spark.range(reps * arms * n).select(F.expr(f"id div {arms * n}").alias("rep"), F.expr(f"(id div {n}) % {arms}").alias("arm"), (F.col("id") % n).alias("slot"))
    u = F.conv(F.substring(by_hash(seed, "rep", "arm", "slot"), 1, 12), 16, 10).cast("double") / float(1 << 48)
    k = F.least(F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e <= u)), F.lit(len(shares) - 1))
    return slots.select("rep", "arm", F.get(F.array(*[F.lit(v) for v, _ in shares]), k).alias("label")).groupBy("rep", "arm", "label").agg(F.count("*").alias("c"))


def divergence_floor(counts: dict[str, int], n: int, reps: int, seed: str, spark) -> DataFrame:
    """(rep, jsd): divergence of two samples of ``n`` from one distribution, which is what chance alone gives."""
    total = sum(counts.values())
    labels = sorted(counts)
    c = _classed(spark, [(v, counts[v] / total) for v in labels], 2, n, reps, seed).groupBy("rep").agg(*[F.coalesce(F.sum(F.when((F.col("arm") == a) & (F.col("label") == v), F.col("c"))), F.lit(0)).alias(f"c{a}_{i}") for a in (0, 1) for i, v in enumerate(labels)])
    q = lambda a, i: (F.col(f"c{a}_{i}") + 1e-12) / (n + 1e-12 * len(labels))
    parts = [0.5 * q(0, i) * F.log2(q(0, i) / ((q(0, i) + q(1, i)) / 2)) + 0.5 * q(1, i) * F.log2(q(1, i) / ((q(0, i) + q(1, i)) / 2)) for i in range(len(labels))]
    return c.select("rep", functools.reduce(operator.add, parts).alias("jsd"))


def row_bootstrap(df: DataFrame, truth: str, pred: str, reps: int, seed: str) -> DataFrame:
    """(rep, macro_f1, accuracy, n) under resampled rows: as many rows are drawn from the counts of (truth, prediction); rows are never repeated."""
    cells = [(r.t, r.p, r.n) for r in M.confusion(df, truth, pred).orderBy("t", "p").collect()]  # labels times labels
    total = sum(n for *_, n in cells)
    if not total:
        return M.macro_f1(M.confusion(df, truth, pred).withColumn("rep", F.lit(0).cast("bigint")), "rep")
    ends = np.cumsum([n for *_, n in cells]).tolist()
    slots = df.sparkSession.range(reps * total).select(F.expr(f"id div {total}").alias("rep"), (F.col("id") % total).alias("slot"))
    pick = F.conv(F.substring(by_hash(seed, "rep", "slot"), 1, 12), 16, 10).cast("bigint") % total
    k = F.size(F.filter(F.array(*[F.lit(int(e)).cast("bigint") for e in ends]), lambda e: e <= pick))
    drawn = slots.select("rep", k.alias("k")).groupBy("rep", "k").agg(F.count("*").alias("n"))
    named = df.sparkSession.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cells)], "k int, t string, p string")
    return M.macro_f1(drawn.join(F.broadcast(named), "k").select("rep", "t", "p", "n"), "rep")


def mean_bootstrap(values: DataFrame, cluster: str, value: str, reps: int, seed: str) -> DataFrame:
    """(rep, mean): mean of one value for each cluster under resampled clusters."""
    rows = values.where(F.col(value).isNotNull())
    w = draws(rows, cluster, reps, seed).join(rows.select(cluster, F.col(value).alias("_v")), cluster)
    return w.groupBy("rep").agg((F.sum(F.col("_v") * F.col("m")) / F.sum("m")).alias("mean"))


def pair_bootstrap(pairs: DataFrame, a: str, b: str, value: str, reps: int, seed: str, least: int = 3) -> DataFrame:
    """(rep, mean, n): mean over the pairs whose both ends are drawn when the ends are resampled; replicates with fewer than ``least`` pairs are left out."""
    ends = pairs.select(F.col(a).alias("e")).union(pairs.select(b))
    d = draws(ends, "e", reps, seed).select("rep", "e")
    both = pairs.join(d.withColumnRenamed("e", a), a).join(d.withColumnRenamed("e", b), ["rep", b])
    return both.groupBy("rep").agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def paired_interval(pairs: DataFrame) -> DataFrame:
    """One row from (rep, f1_one, f1_two): intervals of both, of their ratio, and a two-sided p of their gap."""
    q = lambda c, x: F.percentile(c, F.lit(x))
    rows = pairs.withColumn("ratio", F.when(F.col("f1_two") != 0, F.col("f1_one") / F.col("f1_two")))
    ends = [q(c, x).alias(f"{c}_{n}") for c in ("f1_one", "f1_two", "ratio") for n, x in (("low", 0.025), ("high", 0.975))]
    return rows.agg(*ends, F.least(F.lit(1.0), (1 + F.count_if(F.col("f1_one") <= F.col("f1_two"))) * 2 / (F.count("*") + 1)).alias("gap_p"))


def equivalence(diffs: DataFrame, key: str, diff: str, bound: float, reps: int, seed: str) -> DataFrame:
    """(n, mean, p_lower, p_upper, equivalent): two one-sided sign-flip tests that the mean lies within the bound; both must reject."""
    d = diffs.select(F.col(key).alias("k"), F.col(diff).alias("d")).where("d is not null")
    r = diffs.sparkSession.range(reps).select(F.col("id").alias("rep"))
    sign = F.when(F.substring(by_hash(seed, "rep", "k"), 1, 1) < "8", 1.0).otherwise(-1.0)
    low, high = F.avg((F.col("d") + bound) * sign), F.avg((F.col("d") - bound) * sign)
    t = d.crossJoin(F.broadcast(r)).groupBy("rep").agg(low.alias("lo"), high.alias("hi"))  # reps is a parameter
    s = d.agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    beyond = lambda c: (1 + F.count_if(c)) / (reps + 1)
    out = t.crossJoin(F.broadcast(s)).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), beyond(F.col("lo") <= -F.abs(F.col("mean") + bound) + 1e-12).alias("p_lower"), beyond(F.col("hi") >= F.abs(F.col("mean") - bound) - 1e-12).alias("p_upper"))
    return out.withColumn("equivalent", F.greatest("p_lower", "p_upper") < 0.05)


def block_slope(draws_: DataFrame, level: str, value: str, reps: int, seed: int = 7) -> DataFrame:
    """(n_levels, slope, p, p_floor, low, high): slope of log value on log level, whole levels permuted, and draws resampled inside levels.

    ``draws_`` holds some draws for each of at most eight levels; all orders of the levels are tried on the driver.
    """
    rows = draws_.where((F.col(level) > 0) & (F.col(value) > 0)).groupBy(level).agg(F.sort_array(F.collect_list(F.log(value))).alias("v")).orderBy(level).limit(9).collect()
    if len(rows) > 8:
        raise ValueError("more than eight levels have too many orders")
    shape = "n_levels int, slope double, p double, p_floor double, low double, high double"
    if len(rows) < 2:
        return draws_.sparkSession.createDataFrame([(len(rows), None, None, None, None, None)], shape)
    blocks = [np.array(r.v) for r in rows]
    x = np.repeat(np.log([float(r[level]) for r in rows]), [len(b) for b in blocks])
    centred = x - x.mean()
    slope = lambda y: float(centred @ y / (centred @ centred))
    real = slope(np.concatenate(blocks))
    null = np.array([slope(np.concatenate([blocks[i] for i in order])) for order in itertools.permutations(range(len(blocks)))])
    rng = np.random.default_rng(seed)
    boot = [slope(np.concatenate([rng.choice(b, len(b)) for b in blocks])) for _ in range(reps)]
    low, high = np.percentile(boot, [2.5, 97.5])
    return draws_.sparkSession.createDataFrame([(len(rows), real, float(np.mean(np.abs(null) >= abs(real) - 1e-12)), 1.0 / len(null), float(low), float(high))], shape)


def cluster_bootstrap(df: DataFrame, cluster: str, truth: str, pred: str, reps: int, seed: str) -> DataFrame:
    """(rep, macro_f1, accuracy, n) under resampled clusters: confusion counts per cluster are weighted, rows are never repeated."""
    counts = M.confusion(df, truth, pred, cluster)
    weighted = draws(counts, cluster, reps, seed).join(counts, cluster).groupBy("rep", "t", "p").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    return M.macro_f1(weighted, "rep")


def paired_bootstrap(df: DataFrame, cluster: str, truth: str, one: str, two: str, reps: int, seed: str) -> DataFrame:
    """(rep, f1_one, f1_two): both predictions scored on the same drawn clusters; rows that lack a value are left out of both."""
    rows = df.where(F.col(truth).isNotNull() & F.col(one).isNotNull() & F.col(two).isNotNull())
    a = cluster_bootstrap(rows, cluster, truth, one, reps, seed).select("rep", F.col("macro_f1").alias("f1_one"))
    b = cluster_bootstrap(rows, cluster, truth, two, reps, seed).select("rep", F.col("macro_f1").alias("f1_two"))
    return a.join(b, "rep")


def block_contrast(df: DataFrame, block: str, truth: str, one: str, two: str) -> DataFrame:
    """(n_blocks, better, worse, mean, p, floor): macro-F1 of the first prediction less the second by block, a two-sided sign test and the least p that so many blocks can give."""
    rows = df.where(F.col(truth).isNotNull() & F.col(one).isNotNull() & F.col(two).isNotNull())
    f1 = lambda c, n: M.macro_f1(M.confusion(rows, truth, c, block), block).select(block, F.col("macro_f1").alias(n))
    d = f1(one, "_a").join(f1(two, "_b"), block).select((F.col("_a") - F.col("_b")).alias("d"))
    c = d.agg(F.count("*").alias("n_blocks"), F.count_if(F.col("d") > 1e-12).alias("better"), F.count_if(F.col("d") < -1e-12).alias("worse"), F.avg("d").alias("mean"))
    n, k = F.col("better") + F.col("worse"), F.least("better", "worse")
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(_log_choose(n, i) - n * F.log(F.lit(2.0))))
    return c.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))).withColumn("floor", 3 / (F.pow(F.lit(2.0), "n_blocks") + 1))


def interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """(low, mid, high) quantiles with linear interpolation."""
    a = (1 - level) / 2
    return df.agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in (("low", a), ("mid", 0.5), ("high", 1 - a))])


#: ln 0! to ln 15!; from there on Stirling's series is exact to 1e-13.
_LOG_FACTORIALS = [math.lgamma(i + 1) for i in range(16)]


def _log_factorial(x: Column) -> Column:
    """ln x! in constant time, as every term of a test needs several."""
    y = F.greatest(x, F.lit(16)).cast("double")
    series = (y + 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x < 16, F.get(F.array(*map(F.lit, _LOG_FACTORIALS)), F.greatest(x, F.lit(0)).cast("int"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def fisher(table2: DataFrame) -> DataFrame:
    """(a, b, c, d, odds_ratio, p): two-sided exact test of one row of counts per table."""
    r1, c1, n = F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    lp = lambda x: _log_choose(r1, x) + _log_choose(n - r1, c1 - x) - _log_choose(n, c1)
    lo, hi = F.greatest(F.lit(0), c1 - (n - r1)).cast("bigint"), F.least(r1, c1).cast("bigint")
    # Listed in pieces, so that no array grows with the counts.
    pieces = table2.withColumn("l0", lp(F.col("a"))).withColumn("_hi", hi).withColumn("_at", F.explode(F.sequence(lo, hi, F.lit(4096).cast("bigint"))))
    x = pieces.withColumn("x", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + 4095, F.col("_hi"))))).withColumn("lp", lp(F.col("x")))
    p = F.sum(F.when(F.col("lp") <= F.col("l0") + 1e-7, F.exp("lp")).otherwise(0.0))
    return x.groupBy("a", "b", "c", "d").agg(F.least(F.lit(1.0), p).alias("p")).withColumn("odds_ratio", F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c")))


def mcnemar(df: DataFrame, truth: str, one: str, two: str) -> DataFrame:
    """(only_one, only_two, p): exact test of two predictions on the same rows."""
    a, b = F.col(one) == F.col(truth), F.col(two) == F.col(truth)
    c = df.where(F.col(truth).isNotNull() & F.col(one).isNotNull() & F.col(two).isNotNull()).agg(F.count_if(a & ~b).alias("only_one"), F.count_if(b & ~a).alias("only_two"))
    n, k = F.col("only_one") + F.col("only_two"), F.least("only_one", "only_two")
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(_log_choose(n, i) - n * F.log(F.lit(2.0))))
    return c.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))
