"""Streams: records that arrive twice, and counts in windows of event time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.plans.lineage import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 1) -> DataFrame:
    """The stored table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    # Watermarks need timestamps with a zone; the session's is meant.
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def first_arrivals(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose keys did not arrive before within the watermark; state is dropped behind it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, ts: str, size: str, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums of tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, by: str) -> DataFrame:
    """Sessions of a key that end after a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] = lambda b: b) -> DataFrame:
    """Run the stream over all that is there and give what it wrote, through ``each`` batch by batch.

    A batch's number names its folder, so a batch that is repeated after a failure replaces itself. In the mode
    ``complete`` only the last batch counts.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}"
        each(batch).write.mode("overwrite").parquet(folder)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    got = spark.read.schema(each(spark.createDataFrame([], stream.schema)).schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return got
