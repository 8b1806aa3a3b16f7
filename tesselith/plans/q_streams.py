"""Queries: streams over the events, and the relational extras of the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.sources.tables import table
from tesselith.streaming import arrivals as A

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the hours that the watermark has closed; their state is dropped."""
    got = A.drain(A.window_counts(A.event_stream(spark, d), "ts", "1 hour", "10 minutes", ["event_type"], "value"))
    return got.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return A.drain(A.first_arrivals(A.event_stream(spark, d), ["event_id"], "ts", "1 day")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user that end after half an hour, over the table as it stands."""
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed, from the stream."""
    got = A.drain(A.sessions(A.event_stream(spark, d), "ts", "30 minutes", "10 minutes", "user_id"))
    return got.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def line_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((n_name, r_name), (r_name), ())""")
def orders_by_place(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).select("n_name", "r_name", "n_orders", "total")


@query("SELECT user_id, event_id, event_type, ts, (SELECT max(e.ts) FROM events e WHERE e.user_id = x.user_id AND e.event_type = 'click' AND e.ts < x.ts) AS last_click FROM events x WHERE event_type = 'purchase'")
def last_click_before(spark: SparkSession, d: str) -> DataFrame:
    """As-of: the last click of the user before each purchase, by one window."""
    e = table(spark, d, "events").withColumn("_us", F.expr("unix_micros(cast(ts as timestamp))"))
    w = Window.partitionBy("user_id").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last_click", F.max(F.when(F.col("event_type") == "click", F.col("ts"))).over(w)).where("event_type = 'purchase'").select("user_id", "event_id", "event_type", "ts", "last_click")
