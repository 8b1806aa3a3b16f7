"""Problem 6: splits that keep related documents together.

Documents are related by compiler, by address and by reprint. Borůvka's contraction: every component picks its
lightest edge to another one, the picked edges join the persisted spanning forest and their ends become one
component, until no edge is left. Groups are read off the stored forest: each round holds the component that a
component became part of. The roots, stratified by size bands, are dealt to the splits systematically along the
running size, and each band makes good what the larger bands left.
"""

from __future__ import annotations

import bisect
import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.plans.lineage import materialise, release
from tesselith.sources.tables import table

# What stands for a compiler that is not known.
UNKNOWN = ("", "unknown", "na", "n a", "none", "null", "not known", "anonymous")

#: Shares of the splits, in provisions.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}

#: Groups up to which a band is dealt on the driver, and pieces in which the running size of a larger one is summed up.
LISTED, PIECES = 1000, 256

#: Sub-hubs through which the documents of one shared key are linked.
SALT = 64


def plain_id(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def compiler_key(nation: Column, compiler: Column) -> Column:
    """Nation and name parts, case, spacing, punctuation and order of the parts aside; null where not known."""
    words = F.trim(F.regexp_replace(F.lower(compiler), r"[^\p{L}\p{N}]+", " "))
    where = F.trim(F.regexp_replace(F.lower(nation), r"\s+", " "))
    return F.when(~words.isin(*UNKNOWN), F.concat_ws("|", F.coalesce(where, F.lit("")), F.array_join(F.array_sort(F.split(words, " ")), " ")))


def url_key(url: Column) -> Column:
    """Scheme, leading www., case of the host, fragment and final slash aside; null for a blank address."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?i)[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", "")
    return F.nullif(F.concat(host, F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"/+$", "")), F.lit(""))


def relations(docs: DataFrame) -> DataFrame:
    """(a, b, why): links between documents; a shared key links through salted hubs, so no document gets more than a bounded part of a hot key."""
    d = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.explode(F.array(F.concat(F.lit("c:"), compiler_key(F.col("nation"), F.col("compiler"))), F.concat(F.lit("u:"), url_key(F.col("url"))))).alias("k")
    ).where("k is not null").distinct()
    d = d.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    sub = d.groupBy("k", "s").agg(F.min("doc_id").alias("sub"))
    hub = sub.groupBy("k").agg(F.min("sub").alias("hub"))
    why = lambda c: F.when(F.col(c).startswith("c:"), "compiler").otherwise("url").alias("why")
    shared = d.join(sub, ["k", "s"]).select(F.col("doc_id").alias("a"), F.col("sub").alias("b"), why("k")).unionByName(
        sub.join(hub, "k").select(F.col("sub").alias("a"), F.col("hub").alias("b"), why("k")))
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", plain_id(F.col("doc_id")).alias("p")).distinct()
    reprint = docs.where("doc_id is not null and reprint_of is not null").select(F.col("doc_id").alias("a"), plain_id(F.col("reprint_of")).alias("p")).distinct()
    reprint = reprint.join(ids.withColumnRenamed("doc_id", "b"), "p").select("a", "b", F.lit("reprint").alias("why"))
    return shared.unionByName(reprint).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "why").distinct()


def spanning_forest(edges: DataFrame) -> list[DataFrame]:
    """The stored forest, a table for each round: c, p (the component that c became part of, c itself for a root), a, b, why (the edge that c picked).

    Weights are a hash with the ends as tie-break, so they differ and the picked edges hold no circle. A round
    at least halves the components that still have an edge.
    """
    live = materialise(edges.select("a", "b", "why", F.struct(F.xxhash64("a", "b"), F.col("a"), F.col("b")).alias("w"), F.col("a").alias("ca"), F.col("b").alias("cb")), "live")
    forest: list[DataFrame] = []
    while live.limit(1).count():
        # Every component's lightest edge; two components that picked each other make the smaller one a root.
        ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("o")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("o")))).alias("e")
        pick = materialise(live.select(ends, "w", "a", "b", "why").groupBy("e.c").agg(F.min_by(F.struct("e.o", "a", "b", "why"), "w").alias("m")).select("c", "m.*"), "picks")
        back = pick.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        hook = pick.join(back, "o", "left").select("c", F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"), "a", "b", "why")
        hook = materialise(hook, "hooks")
        while True:  # follow to the roots; two steps a pass, so chains become a quarter
            up = lambda k: hook.select(F.col("c").alias(f"p{k}"), F.col("p").alias(f"p{k + 1}"))
            nxt = hook.withColumnRenamed("p", "p1").join(up(1), "p1").join(up(2), "p2").join(up(3), "p3")
            nxt = materialise(nxt.select("c", F.col("p4").alias("p"), "a", "b", "why", (F.col("p4") != F.col("p1")).alias("moved")), "hooks")
            release(hook)
            hook = nxt
            if not hook.where("moved").limit(1).count():
                break
        to = hook.select("c", "p")
        step = live.join(to.select(F.col("c").alias("ca"), F.col("p").alias("pa")), "ca").join(to.select(F.col("c").alias("cb"), F.col("p").alias("pb")), "cb")
        new_live = materialise(step.where("pa <> pb").select("a", "b", "why", "w", F.col("pa").alias("ca"), F.col("pb").alias("cb")), "live")
        for old in (live, pick):
            release(old)
        forest.append(hook)
        live = new_live
    release(live)
    return forest


def trees(forest: list[DataFrame]) -> DataFrame:
    """(a, b, why, round): the edges of a stored forest that has rounds; a component is one edge more than it has edges."""
    rounds = [f.select("a", "b", "why", F.lit(i).alias("round")).distinct() for i, f in enumerate(forest)]
    return functools.reduce(DataFrame.unionByName, rounds)


def roots(forest: list[DataFrame]) -> DataFrame:
    """(v, comp): every vertex of a stored forest that has rounds with its root, from the last round to the first."""
    known = forest[-1].select(F.col("c").alias("v"), F.col("p").alias("comp"))
    for lower in reversed(forest[:-1]):
        # A root of the last rounds has no edge in a later one and stands for itself.
        known = lower.select(F.col("c").alias("v"), "p").join(known.withColumnRenamed("v", "p"), "p", "left").select("v", F.coalesce("comp", "p").alias("comp"))
    return known


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document related to another one; group_id is the smallest doc_id.

    Repeated rows are one; null doc_ids relate nothing; null, blank and unknown compilers, blank addresses and
    reprints of nothing or of the row itself relate nothing; an empty table gives an empty table.
    """
    forest = spanning_forest(relations(docs))
    if not forest:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, group_id {kind}")
    comp = materialise(roots(forest), "roots")
    low = comp.groupBy("comp").agg(F.min("v").alias("group_id"))
    return comp.join(low, "comp").select(F.col("v").alias("doc_id"), "group_id")


def deal(docs: DataFrame, provisions: DataFrame, shares: dict[str, float] | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, group_id, n_provisions, split): all documents of a group in one split, shares counted in provisions.

    Groups are ordered by size band (powers of two, large first) and by hash inside a band. A band's shares are what
    the larger bands left of each split's target; its groups lie side by side on a line, in hash order, each as long
    as it is large, and the middle of a group tells in which split's part of the line it falls. A group without
    provisions has size 0 and counts as one document. Empty tables give an empty table.
    """
    shares = shares or SHARES
    order = sorted(shares, key=lambda s: -shares[s])
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    sizes = provisions.where("provision_id is not null").select("doc_id", "provision_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_provisions"))
    member = materialise(
        ids.join(groups(docs), "doc_id", "left").join(sizes, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_provisions", F.lit(0)).cast("bigint").alias("n_provisions")),
        "documents",
    )
    g = member.groupBy("group_id").agg(F.sum("n_provisions").alias("size"))
    length = F.greatest(F.col("size"), F.lit(1))
    g = materialise(g.select("*", length.alias("len"), F.floor(F.log2(F.col("size") + 1)).cast("int").alias("band"), F.xxhash64(F.lit(seed), "group_id").alias("o"), F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.lit(PIECES)).alias("piece")), "related")
    pieces = g.groupBy("band", "piece").agg(F.sum("len").alias("len"), F.sum("size").alias("size"), F.count("*").alias("n"))
    bands: dict[int, list] = {}
    for r in pieces.groupBy("band").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.sum("len").alias("len")).collect():  # a row for each power of two
        bands[r.band] = [r.size, r.n, r.len]
    listed = [b for b, (_, n, _) in bands.items() if n <= LISTED]
    rows: dict[int, list] = {b: [] for b in listed}
    for r in g.where(F.col("band").isin(listed)).select("band", "piece", "o", "group_id", "size", "len").collect():  # at most LISTED groups a band
        rows[r.band].append((r.piece, r.o, r.group_id, r.size, r.len))
    have, total, named, parts = dict.fromkeys(order, 0.0), 0, [], []
    for band in sorted(bands, reverse=True):
        size, _, whole = bands[band]
        total += size
        left = [max(0.0, total * shares[s] - have[s]) if size else shares[s] for s in order]
        ends = list(itertools.accumulate(x / sum(left) if sum(left) else shares[s] for x, s in zip(left, order)))
        if band in rows:
            at = 0
            for _, _, group, n, length_ in sorted(rows[band]):
                s = order[min(bisect.bisect_right(ends, (at + length_ / 2) / whole), len(order) - 1)]
                at += length_
                have[s] += n
                named.append((group, s))
        else:
            for s, lo, hi in zip(order, [0.0, *ends], ends):
                have[s] += size * (hi - lo)
            parts.append((band, whole, ends))
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = spark.createDataFrame(named, f"group_id {kind}, split string")
    if parts:
        before = Window.partitionBy("band").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        begins = pieces.select("band", "piece", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("l0"))
        inside = F.sum("len").over(Window.partitionBy("band", "piece").orderBy("o", "group_id"))
        line = spark.createDataFrame(parts, "band int, whole bigint, ends array<double>")  # a row for each large band
        place = g.join(F.broadcast(line), "band").withColumn("upto", inside).join(F.broadcast(begins), ["band", "piece"])  # PIECES rows a band
        middle = (F.col("l0") + F.col("upto") - F.col("len") / 2) / F.col("whole")
        k = F.least(F.size(F.filter("ends", lambda e: e <= middle)), F.lit(len(order) - 1))
        known = known.unionByName(place.select("group_id", F.get(F.array(*map(F.lit, order)), k).alias("split")))
    return member.join(known, "group_id").select("doc_id", "group_id", "n_provisions", "split")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related documents and their groups."""
    return groups(table(spark, sf_dir, "harvest_docs"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every harvested document."""
    return deal(table(spark, sf_dir, "harvest_docs"), table(spark, sf_dir, "corpus"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, groups and share of the provisions of every split."""
    n = F.sum("n_provisions")
    return p6_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_docs"), F.count_distinct("group_id").alias("n_groups"), n.alias("n_provisions")).withColumn(
        "share", F.col("n_provisions") / F.sum("n_provisions").over(Window.partitionBy()))


SQL = {
    "p6_found": """
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, nation, compiler, url, reprint_of FROM harvest_docs WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, 'c' || trim(regexp_replace(lower(nation), '\\s+', ' ', 'g')) || '|' || array_to_string(list_sort(string_split(trim(regexp_replace(lower(compiler), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') k
      FROM d WHERE trim(regexp_replace(lower(compiler), '[^a-z0-9]+', ' ', 'g')) NOT IN ('', 'unknown', 'na', 'n a', 'none', 'null', 'not known', 'anonymous')
  UNION SELECT doc_id, 'u' || regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\\.', '') || regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '/+$', '')
      FROM (SELECT doc_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') u FROM d) WHERE u <> ''),
m AS (SELECT k, min(doc_id) h FROM k GROUP BY k),
e AS (SELECT k.doc_id a, m.h b FROM k JOIN m USING (k) UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON lower(trim(x.reprint_of)) = lower(trim(y.doc_id))),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(v, w) AS (SELECT a, a FROM s UNION SELECT r.v, s.b FROM r JOIN s ON s.a = r.w)
SELECT v AS doc_id, min(w) AS group_id FROM r GROUP BY v
""",
}
