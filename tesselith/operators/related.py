"""Walks over a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions.text import host
from tesselith.plans.lineage import materialise


def crawl_links(links: DataFrame, follow: str, skip: str, same_host: bool = True) -> DataFrame:
    """Links (src, dst, anchor) that a crawl follows: address or anchor match ``follow`` and not ``skip``, on the same host if asked."""
    both = F.concat_ws(" ", "dst", "anchor")
    kept = links.where(both.rlike(f"(?i){follow}") & ~F.col("dst").rlike(f"(?i){skip}"))
    return kept.where(host(F.col("src")) == host(F.col("dst"))) if same_host else kept


def targets(pages: DataFrame, target: str, least_pdf: int, least_html: int) -> DataFrame:
    """Fetched pages (url, anchor, kind, size) worth keeping: their address or anchor matches, and they are large enough for their kind."""
    big = F.when(F.col("kind") == "pdf", F.col("size") > least_pdf).otherwise(F.col("size") > least_html)
    return pages.where(F.concat_ws(" ", "url", "anchor").rlike(f"(?i){target}") & big)


def discovered(anchors: DataFrame, page: str, pattern: str, most: int) -> DataFrame:
    """Links (page, pos, href, anchor) whose address or anchor matches, each address once a page, the first ``most`` of a page: a polite crawl's own bound."""
    hits = anchors.where(F.concat_ws(" ", "href", "anchor").rlike(f"(?i){pattern}"))
    once = hits.groupBy(page, "href").agg(F.min_by(F.struct("pos", "anchor"), "pos").alias("r")).select(page, "href", "r.*")
    return once.withColumn("_k", F.row_number().over(Window.partitionBy(page).orderBy("pos", "href"))).where(F.col("_k") <= most).drop("_k")


def walk(links: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(node, depth): nodes within ``depth`` links of a seed, each at its least depth.

    ``links``: src, dst; ``seeds``: node. The frontier is joined with the links and loses what was seen before; one
    job a level. With ``most`` a level takes only its first nodes by name, as a polite crawl does.
    """
    seen = materialise(seeds.distinct().withColumn("depth", F.lit(0)), "walk")
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        if most is not None:
            step = step.orderBy("node").limit(most)
        frontier = materialise(step, "walk")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen
