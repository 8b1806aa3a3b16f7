"""JSON, CSV and text sources and sinks with the behaviour of a staged pipeline."""

from __future__ import annotations

import io
import logging
import lzma
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The schema of a passage; keys that a record lacks are null.
PASSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("provision_id", "doc_id", "nation", "source_url", "doc_title", "doc_kind")]
    + [T.StructField("doc_year", T.IntegerType()), T.StructField("ocr", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("domain", "domain_src", "section", "heading", "text", "history", "chapter", "chapter_heading", "heading_path")]
    + [T.StructField("char_offset", T.IntegerType()), T.StructField("unnumbered", T.BooleanType()), T.StructField("platform", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("xnation_dup", T.BooleanType())]
)

# The schema of a harvest manifest: one element a seed, with its documents nested.
MANIFEST = "nation string, seed string, pages_fetched int, docs array<struct<nation:string,url:string,anchor:string,file:string,kind:string,bytes:bigint,chars:bigint>>"


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str = PASSAGE, drop_near_dups: bool = False) -> DataFrame:
    """One JSON record a line; broken lines are left out; optionally without flagged near-duplicates."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.where(~F.coalesce("xnation_dup", F.lit(False))) if drop_near_dups else df


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON record a line; nulls are left out. A path that ``df`` reads must not be overwritten."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a manifest (a JSON array), one row each with their seed."""
    df = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    return df.select("seed", "pages_fetched", F.inline("docs"))


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at ``path`` lacks; the number appended. Running it again appends nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def read_coded(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """(i, label) of a coded sheet exported as CSV with a header; a label that is not allowed is an error."""
    df = spark.read.schema("i int, label string").option("header", "true").csv(path)
    bad = F.raise_error(F.concat(F.lit("unknown label: "), F.col("label")))
    return df.select("i", F.when(F.col("label").isNull() | F.col("label").isin(labels), F.col("label")).otherwise(bad).alias("label"))


def read_replies(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, text) of a folder of text files, one row a file; the tag is the file's name without its ending."""
    df = spark.read.text(folder, wholetext=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("tag"), F.col("value").alias("text"))


def resolve(spark: SparkSession, *paths: str) -> str:
    """The first path that exists."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def write_array(df: DataFrame, path: str) -> None:
    """One JSON array in one file, as manifests are exchanged: for tables of bounded size only."""
    one = df.agg(F.collect_list(F.struct(*df.columns)).alias("rows")).select(F.to_json("rows").alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_xz_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON records, one a line, of files compressed with xz: a file is read by one task, line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                held: list[str] = []
                with lzma.open(io.BytesIO(data.as_py()), "rt", encoding="utf-8", errors="replace") as f:
                    for line in f:
                        held.append(line)
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])
                            held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    return lines.select(F.from_json("line", schema).alias("r")).where("r is not null").select("r.*")


def write_sheet(df: DataFrame, path: str, labels: list[str], label: str = "label") -> None:
    """A sheet for coders as CSV with a header, and beside it the list of labels that it accepts; a label outside the list is an error."""
    bad = F.raise_error(F.concat(F.lit("unknown label: "), F.col(label)))
    checked = df.withColumn(label, F.when(F.col(label).isNull() | F.col(label).isin(labels), F.col(label)).otherwise(bad))
    checked.orderBy("i").coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/sheet")
    df.sparkSession.createDataFrame([(x,) for x in labels], "label string").coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/labels")


def prior_labels(spark: SparkSession, pattern: str, items: DataFrame) -> DataFrame:
    """``items`` (i, ...) with the ``label`` that earlier JSON files (i, label) gave; of several files the last by name counts."""
    old = spark.read.schema("i int, label string").option("multiLine", "true").json(pattern).withColumn("_f", F.col("_metadata.file_name")).where("i is not null")
    return items.join(old.groupBy("i").agg(F.max_by("label", "_f").alias("label")), "i", "left")


def save_point(df: DataFrame, path: str, **point: str | int | float) -> None:
    """Append one point's results, with the columns that name it, unless the table holds that point already."""
    named = df.withColumns({k: F.lit(v) for k, v in point.items()}).withColumn("point", F.lit("|".join(f"{k}={v}" for k, v in sorted(point.items()))))
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        named = named.join(spark.read.parquet(path).select("point").distinct(), "point", "left_anti")
    named.write.mode("append").parquet(path)


def progress(message: str, *args: object) -> None:
    """A line with the time in the log of long jobs."""
    logging.getLogger("tesselith").info(f"%s {message}", time.strftime("%H:%M:%S"), *args)
