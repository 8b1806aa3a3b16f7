"""Problem 3: one group for all records that are linked directly or through others.

Two-dimensional grid: vertices are hashed to blocks, an edge belongs to the cell of its two blocks, and every
cell runs a local union-find. Cells of one row or column share vertices; the representatives they found are
exchanged by a minimum, chains of parents are shortened until they stay, and what still links two
representatives is the edge list of the next round. The edges of a hub spread over all cells of its row.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.plans.lineage import materialise, release
from tesselith.sources.tables import table

#: Edges that one cell of the grid holds at most on average.
CELL_EDGES = 200_000

#: Rows and columns of the smallest grid; a larger one has a cell for each core or for CELL_EDGES edges.
LEAST_BLOCKS = 4


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    """The smallest member for every other member of each local component."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for a, b in zip(pdf["a"].to_numpy(), pdf["b"].to_numpy()):
        ra, rb = find(a), find(b)
        if ra != rb:
            lo, hi = (ra, rb) if ra < rb else (rb, ra)
            parent[hi] = lo
    vertices = [v for v in parent]
    return pd.DataFrame({"v": vertices, "rep": [find(v) for v in vertices]}, dtype=object)


def _shorten(parent: DataFrame) -> DataFrame:
    """Follow parents until they are roots; every pass halves the chains."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("rep").alias("pp"))
        nxt = materialise(parent.withColumnRenamed("rep", "p").join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("rep"), F.col("pp").isNotNull().alias("moved")), "parents")
        release(parent)
        parent = nxt
        if not parent.where("moved").limit(1).count():
            return parent


def components(edges: DataFrame, a: str = "a", b: str = "b", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(v, root): every vertex of ``edges`` that is linked to another one, with the smallest vertex of its group.

    Null sides and links of a vertex to itself link nothing; repeats and both directions count once; an empty
    table gives an empty table; extra columns are ignored.
    """
    x, y = F.col(a), F.col(b)
    e = materialise(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
    kind = e.schema["a"].dataType.simpleString()
    levels: list[DataFrame] = []
    cores = edges.sparkSession.sparkContext.defaultParallelism
    while n := e.count():
        blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(2 * max(n / cell_edges, cores))))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        cells = e.select("a", "b", F.least(block("a"), block("b")).alias("row"), F.greatest(block("a"), block("b")).alias("col"))
        stars = materialise(cells.groupBy("row", "col").applyInPandas(lambda p: _union_find(p), f"v {kind}, rep {kind}"), "stars")
        release(e)
        parent = _shorten(materialise(stars.groupBy("v").agg(F.min("rep").alias("rep")), "parents"))
        up = parent.select("v", "rep")  # the optimizer broadcasts it where its size, once written, allows
        root = lambda d, c: d.join(up.select(F.col("v").alias(c), F.col("rep").alias(f"_{c}")), c, "left").select(*[k for k in d.columns if k != c], F.coalesce(f"_{c}", c).alias(c))
        linked = root(root(stars.select(F.col("v").alias("a"), F.col("rep").alias("b")), "a"), "b").where("a <> b")
        e = materialise(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(stars)
        levels.append(parent)
    release(e)
    spark = edges.sparkSession
    if not levels:
        return spark.createDataFrame([], f"v {kind}, root {kind}")
    known = levels[-1].select("v", F.col("rep").alias("root"))
    for lower in reversed(levels[:-1]):
        up = known.select(F.col("v").alias("rep"), F.col("root"))
        known = lower.select("v", "rep").join(up, "rep", "left").select("v", F.coalesce("root", "rep").alias("root")).unionByName(known)
    known = materialise(known, "groups")
    for level in levels:
        release(level)
    roots = known.select(F.col("root").alias("v"), "root").distinct()
    return known.unionByName(roots)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provision of match_pairs linked to another one, with the smallest provision of its group."""
    clean = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), F.lit(""))
    pairs = table(spark, sf_dir, "match_pairs").select(clean("left_id").alias("a"), clean("right_id").alias("b"))
    return components(pairs).select(F.col("v").alias("provision_id"), F.col("root").alias("group_id"))


SQL = {
    "p3_found": """
WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(left_id)) a, lower(trim(right_id)) b FROM match_pairs WHERE trim(left_id) <> '' AND trim(right_id) <> '' AND lower(trim(left_id)) <> lower(trim(right_id))),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, w) AS (SELECT a, a FROM s UNION SELECT r.v, s.b FROM r JOIN s ON s.a = r.w)
SELECT v AS provision_id, min(w) AS group_id FROM r GROUP BY v
""",
}
