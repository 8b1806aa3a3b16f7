"""Problem 1: a sample whose category shares follow given targets.

Systematic unequal-probability sampling. Within the sorted categories of a request the records stand in a
random (hashed) order; the running sum of their inclusion probabilities is formed by prefix sums over order
buckets, so that no category is ever sorted in one task; a record is drawn where the running sum plus one
random start passes an integer. Then categories below their floor get their next records.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.plans.lineage import materialise
from tesselith.plans.sizing import small
from tesselith.sources.tables import table

FIELDS = ("silver", "domain", "nation")

#: Pieces into which the random order of a category is cut; a piece is the most that one task sorts.
ORDER_BUCKETS = 1024


def plain(c: Column) -> Column:
    """Lower case, surplus white space removed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _start(request: str, seed: int) -> float:
    return int.from_bytes(hashlib.sha256(f"{seed}|{request}".encode()).digest()[:6], "big") / 2**48


def draw(records: DataFrame, targets: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "provision_id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The sample and its report.

    ``records``: one or more rows per ``key``; of repeated rows the smallest value of each field counts. A record
    is in a category if its field equals it, case and surplus spaces aside; null or blank fields are in none but
    count in the total; null keys are no records. ``targets``: request_id, field_name, category, target_share,
    min_rows, sample_fraction; null shares, floors and fractions count as 0; repeated targets are one. Tables
    without rows give a sample and report without rows, or targets that are all short. Extra columns are ignored.

    Sample: request_id, category, key, inclusion, added_by (``systematic`` or ``floor``).
    Report: request_id, field_name, category, available, wanted, min_rows, drawn, drawn_share, short.
    """
    spark = records.sparkSession
    one = materialise(
        records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*[F.min(plain(F.col(f))).alias(f"_f{i}") for i, f in enumerate(fields)]), "provisions"
    )
    n_all = one.count()
    wanted = F.coalesce(F.col("target_share"), F.lit(0.0)) * F.coalesce(F.col("sample_fraction"), F.lit(0.0)) * F.lit(float(n_all))
    goals = targets.select(
        "request_id", "field_name", "category", plain(F.col("category")).alias("_value"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), wanted.alias("wanted")
    ).dropDuplicates(["request_id", "field_name", "_value"])
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_f{i}").alias("_value")) for i, f in enumerate(fields)])
    long = one.select("_key", F.inline(pairs)).where("_value is not null and _value <> ''")
    member = long.join(small(goals), ["field_name", "_value"]).select("request_id", "field_name", "_value", "_key")
    order = F.xxhash64(F.lit(seed), "request_id", "_key")
    member = member.select("*", order.alias("_o"), F.pmod(F.shiftrightunsigned(order, 32), F.lit(ORDER_BUCKETS)).alias("_b"))

    # Prefix sums over (category, bucket): a few thousand rows for each request.
    per = ["request_id", "field_name", "_value"]
    counts = member.groupBy(*per, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        *per, "_b", (F.sum("_n").over(Window.partitionBy(*per).orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*per)).alias("available")
    )
    avail = counts.groupBy(*per).agg(F.sum("_n").alias("available"))
    state = goals.join(avail, per, "left").select(*goals.columns, F.coalesce("available", F.lit(0)).cast("bigint").alias("available"))
    state = state.withColumn("pi", F.when(F.col("available") > 0, F.least(F.lit(1.0), F.col("wanted") / F.col("available"))).otherwise(0.0))
    upto = Window.partitionBy("request_id").orderBy("field_name", "_value").rowsBetween(Window.unboundedPreceding, -1)
    state = state.withColumn("_base", F.coalesce(F.sum(F.col("available") * F.col("pi")).over(upto), F.lit(0.0)))
    state = materialise(state, "targets")
    requests = [r[0] for r in state.select("request_id").distinct().collect()]
    starts = spark.createDataFrame([(r, _start(str(r), seed)) for r in requests], f"request_id {targets.schema['request_id'].dataType.simpleString()}, _u double")

    in_bucket = Window.partitionBy(*per, "_b").orderBy("_o", "_key")
    ranked = (
        member.withColumn("_in", F.row_number().over(in_bucket))
        .join(offsets.select(*per, "_b", "_before"), [*per, "_b"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .join(small(state.select(*per, "category", "min_rows", "available", "pi", "_base")), per)
        .join(F.broadcast(starts), "request_id")
    )
    run = lambda k: F.floor(F.col("_base") + k * F.col("pi") + F.col("_u"))
    ranked = ranked.withColumn("_hit", (F.col("pi") >= 1.0) | (run(F.col("_rank")) > run(F.col("_rank") - 1)))
    floor_ = F.least("min_rows", "available")
    # The first min_rows records of a category hold enough that are not drawn to repair its floor.
    kept = materialise(
        ranked.where(F.col("_hit") | (F.col("_rank") <= floor_)).select(*per, "category", F.col("_key").alias(key), F.col("pi").alias("inclusion"), "_rank", "_hit", floor_.alias("_floor")),
        "drawn",
    )
    drawn = kept.where("_hit").groupBy(*per).agg(F.count("*").alias("_d"))
    spare = Window.partitionBy(*per).orderBy("_rank")
    repair = (
        kept.where("not _hit").join(drawn, per, "left").withColumn("_need", F.col("_floor") - F.coalesce("_d", F.lit(0)))
        .where("_need > 0").withColumn("_k", F.row_number().over(spare)).where("_k <= _need")
    )
    cols = ["request_id", "field_name", "_value", "category", key, "inclusion"]
    sample = kept.where("_hit").select(*cols, F.lit("systematic").alias("added_by")).unionByName(repair.select(*cols, F.lit("floor").alias("added_by")))
    total = Window.partitionBy("request_id")
    report = (
        state.join(sample.groupBy(*per).agg(F.count("*").alias("drawn")), per, "left")
        .select("request_id", "field_name", "category", "available", "wanted", "min_rows", F.coalesce("drawn", F.lit(0)).cast("bigint").alias("drawn"))
        # Short is a category of which everything was drawn, and still too little.
        .withColumn("short", (F.col("drawn") == F.col("available")) & (F.col("drawn") < F.greatest(F.col("min_rows").cast("double"), F.col("wanted"))))
        .select("request_id", "field_name", "category", "available", "wanted", "min_rows", "drawn", "short")
        .withColumn("drawn_share", F.try_divide(F.col("drawn"), F.sum("drawn").over(total)))
    )
    return sample.drop("field_name", "_value"), report


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return draw(table(spark, sf_dir, "corpus").select("provision_id", *FIELDS), table(spark, sf_dir, "sample_targets"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that the sample cannot meet."""
    return _both(spark, sf_dir)[1].where("short").select("request_id", "category")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn provisions of every request."""
    return _both(spark, sf_dir)[0]


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available, wanted and drawn provisions of every target."""
    return _both(spark, sf_dir)[1].withColumns({c: F.round(c, 8) for c in ("wanted", "drawn_share")})


_HAVE = """
WITH one AS (SELECT provision_id, min(trim(regexp_replace(lower(silver), '\\s+', ' ', 'g'))) silver, min(trim(regexp_replace(lower(domain), '\\s+', ' ', 'g'))) AS "domain",
              min(trim(regexp_replace(lower(nation), '\\s+', ' ', 'g'))) nation FROM corpus WHERE provision_id IS NOT NULL GROUP BY 1),
long AS (SELECT 'silver' f, silver v, provision_id FROM one UNION ALL SELECT 'domain', "domain", provision_id FROM one UNION ALL SELECT 'nation', nation, provision_id FROM one),
have AS (SELECT f, v, count(*) n FROM long GROUP BY 1, 2)
"""

SQL = {
    "p1_found": _HAVE
    + """SELECT t.request_id, t.category FROM sample_targets t LEFT JOIN have h ON h.f = t.field_name AND h.v = trim(regexp_replace(lower(t.category), '\\s+', ' ', 'g'))
WHERE coalesce(h.n, 0) < greatest(t.min_rows, t.target_share * t.sample_fraction * (SELECT count(*) FROM one))
""",
    # The draw's size in a category: the integers that its part of the running sum passes, or its floor.
    "p1_report": _HAVE
    + """, t AS (SELECT DISTINCT request_id, field_name, category, coalesce(min_rows, 0) AS min_rows, coalesce(target_share, 0.0) * coalesce(sample_fraction, 0.0) * (SELECT count(*) FROM one)::DOUBLE AS wanted,
  coalesce(h.n, 0) AS available, ('0x' || substr(sha256('7|' || request_id), 1, 12))::BIGINT / 281474976710656.0 AS u, trim(regexp_replace(lower(category), '\\s+', ' ', 'g')) AS value
  FROM sample_targets LEFT JOIN have h ON h.f = field_name AND h.v = trim(regexp_replace(lower(category), '\\s+', ' ', 'g'))),
p AS (SELECT *, CASE WHEN available > 0 THEN least(1.0, wanted / available) ELSE 0.0 END AS pi FROM t),
b AS (SELECT *, coalesce(sum(available * pi) OVER (PARTITION BY request_id ORDER BY field_name, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS base FROM p),
d AS (SELECT *, greatest(CASE WHEN pi >= 1 THEN available ELSE floor(base + available * pi + u) - floor(base + u) END, least(min_rows, available))::BIGINT AS drawn FROM b)
SELECT request_id, field_name, category, available, round(wanted, 8) AS wanted, min_rows, drawn, drawn = available AND drawn < greatest(min_rows, wanted) AS short, round(drawn / nullif(sum(drawn) OVER (PARTITION BY request_id), 0)::DOUBLE, 8) AS drawn_share FROM d
""",
}
