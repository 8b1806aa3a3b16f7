"""Problem 9: mixtures of sources with target shares of the size and a cap on repeats.

A multivariate-hypergeometric splitting tree. The documents of a source are cut into blocks of some size by a hash; a
mixture takes whole passes over the permuted blocks of a source and then as many blocks (the last one cut
between documents) as its quota needs. The exact block quotas of all sources are divided among the output
shards by splitting the range of shards in halves, each half drawing its blocks without replacement; a shard
then owns disjoint runs of the permuted blocks and shuffles its documents locally. Sizes are numbers of token ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.llm.tokenizer import VOCABULARY, encode
from tesselith.plans.lineage import materialise, release
from tesselith.plans.sizing import small
from tesselith.sources.tables import table

#: Tokens of a block and of an output shard; their numbers grow with the sources and the mixture.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 26

#: A small source has this many blocks, if each then holds BLOCK_DOCS documents; a small mixture has this many shards.
LEAST_BLOCKS, BLOCK_DOCS, LEAST_SHARDS = 64, 4, 8

#: Pieces in which the permuted blocks of a source are summed up.
PIECES = 64


def split_quotas(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): block counts by shard, whose sums over shards are ``quota`` exactly.

    A node with n shards gives floor(n/2) of them their share of its blocks, drawn by a multivariate
    hypergeometric law, so every arrangement of the blocks is equally likely.
    """
    if shards == 1:
        return quota[None, :]
    left, total = shards // 2, int(quota.sum())
    take = total * left // shards
    if total * left % shards and rng.random() < total * left % shards / shards:
        take += 1
    mine = rng.multivariate_hypergeometric(quota, take, method="marginals") if total else quota * 0
    return np.vstack([split_quotas(mine, left, rng), split_quotas(quota - mine, shards - left, rng)])


def sized_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens): encoded by the tokenizer operator; null and empty texts have size 0."""
    key = F.struct("doc_id", "source")
    return encode(docs.select(key.alias("k"), "text"), "k", "text", vocabulary, lengths_only=True).select("k.*", "n_tokens")


def mix(docs: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 13, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixtures and their report.

    ``docs``: doc_id, source, text, one row per document; documents of size 0 or without source are drawn
    never, but those without source count in the total. ``targets``: mix_id, source, target_share,
    max_repeats, size_ratio; null numbers count as 0; a source without documents is a shortfall. Empty tables
    give empty mixtures. Extra columns are ignored. A mixture has a shard for every SHARD_TOKENS, or ``shards``.

    Mixture: mix_id, shard, place, doc_id, source, repeat (0 for the first use), n_tokens.
    Report: mix_id, source, source_tokens, wanted, planned, actual, actual_share, target_share, max_repeats, short.
    """
    sized = materialise(sized_documents(docs, vocabulary), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count_if(F.col("n_tokens") > 0).alias("n_docs"))
    blocks_of = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_tokens") / BLOCK_TOKENS))
    per_source = materialise(per_source.withColumn("n_blocks", F.greatest(F.lit(1), F.least(blocks_of, F.floor(F.col("n_docs") / BLOCK_DOCS))).cast("int")), "sources")
    total = per_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).first()[0]
    share, ratio, cap = (F.coalesce(F.col(c), F.lit(0)) for c in ("target_share", "size_ratio", "max_repeats"))
    goals = targets.dropDuplicates(["mix_id", "source"]).join(small(per_source), "source", "left").select(
        "mix_id", "source", share.alias("target_share"), cap.cast("int").alias("max_repeats"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        (share * ratio * F.lit(total)).alias("wanted"))
    most = F.col("max_repeats") * F.col("source_tokens")
    goals = materialise(goals.withColumn("planned", F.least(F.col("wanted"), most.cast("double"))), "goals")

    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_blocks")).cast("int").alias("block")
    placed = sized.where("n_tokens > 0").join(small(per_source.select("source", "n_blocks")), "source").select("doc_id", "source", "n_tokens", block)
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    use = goals.where("planned > 0").select("mix_id", "source", "planned", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)).alias("repeat"))
    # The permuted blocks of a source by repeat and piece: no source is summed up in one task.
    order = F.xxhash64(F.lit(seed), "mix_id", "source", "repeat", "block")
    run = ["mix_id", "source", "repeat", "piece"]
    dealt = use.join(blocks, "source").withColumn("o", order).withColumn("piece", F.pmod(F.shiftrightunsigned("o", 40), F.lit(PIECES)).cast("int"))
    before = Window.partitionBy("mix_id", "source").orderBy("repeat", "piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*run).agg(F.sum("block_tokens").alias("t"), F.count("*").alias("k")).select(*run, F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    walk = Window.partitionBy(*run).orderBy("o", "block")
    taken = dealt.withColumn("upto", F.sum("block_tokens").over(walk)).withColumn("turn", F.row_number().over(walk)).join(sums, run)
    taken = taken.withColumn("upto", F.col("upto") + F.col("t0")).withColumn("turn", F.col("turn") + F.col("k0")).drop("o", "piece", "t0", "k0")
    taken = materialise(taken.where(F.col("upto") - F.col("block_tokens") < F.col("planned")).withColumn("room", F.col("planned") - F.col("upto") + F.col("block_tokens")), "blocks")

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        mix_id = pdf["mix_id"].iloc[0]
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{mix_id}".encode()).digest()[:8], "big"))
        n = shards or max(LEAST_SHARDS, -(-int(pdf["size"].sum()) // SHARD_TOKENS))
        counts = split_quotas(pdf["quota"].to_numpy(np.int64), n, rng)
        ends = counts.cumsum(axis=0)
        s, k = np.nonzero(counts)
        return pd.DataFrame({"mix_id": mix_id, "source": pdf["source"].to_numpy()[k], "shard": s, "first": ends[s, k] - counts[s, k] + 1, "last": ends[s, k]})

    kinds = {c: targets.schema[c].dataType.simpleString() for c in ("mix_id", "source")}
    runs = taken.groupBy("mix_id", "source").agg(F.count("*").alias("quota"), F.sum(F.least("block_tokens", "room")).cast("bigint").alias("size")).groupBy("mix_id").applyInPandas(
        tree, f"mix_id {kinds['mix_id']}, source {kinds['source']}, shard int, first bigint, last bigint")
    owner = taken.join(small(runs), ["mix_id", "source"]).where("turn between first and last").select("mix_id", "source", "repeat", "block", "room", "block_tokens", "shard")
    drawn = owner.join(placed, ["source", "block"])
    # Only the last block of a quota is cut between documents.
    whole = F.col("room") >= F.col("block_tokens")
    cut = Window.partitionBy("mix_id", "source", "repeat", "block").orderBy(F.xxhash64(F.lit(seed), "mix_id", "repeat", "doc_id"), "doc_id")
    last = drawn.where(~whole).withColumn("upto", F.sum("n_tokens").over(cut)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("room"))
    columns = ["mix_id", "shard", "doc_id", "source", "repeat", "n_tokens"]
    drawn = materialise(drawn.where(whole).select(*columns).unionByName(last.select(*columns)), "mixture")
    release(taken)
    local = Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64(F.lit(seed), "mix_id", "shard", "repeat", "doc_id"), "doc_id", "repeat")
    mixture = drawn.select("mix_id", "shard", F.row_number().over(local).alias("place"), "doc_id", "source", "repeat", "n_tokens")
    actual = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("actual"))
    report = goals.join(actual, ["mix_id", "source"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    # Short is a source of which every document was drawn as often as allowed, and still too little.
    report = report.select("mix_id", "source", "source_tokens", "wanted", "planned", "actual", "target_share", "max_repeats", ((F.col("actual") >= most) & (F.col("actual") < F.col("wanted"))).alias("short"))
    report = report.withColumn("actual_share", F.try_divide(F.col("actual"), F.sum("actual").over(Window.partitionBy("mix_id"))))
    return mixture, report


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that the repeat cap keeps out of reach."""
    return _both(spark, sf_dir)[1].where("short").select("mix_id", "source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mixture by shard and place."""
    return _both(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, planned and actual sizes of every target."""
    return _both(spark, sf_dir)[1]
