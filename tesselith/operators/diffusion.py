"""Near-duplicates across groups by an inverted index over shingles."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.plans.lineage import materialise, release

#: Postings that are counted at once, and most passes over them: the exchange of a pass holds the longest rows, so it must not hold all.
PASS_ROWS, MOST_PASSES = 6_000_000, 8

#: Cells in which shingles are counted, at least and at most, as powers of two; a cell is sent as one byte.
LEAST_CELLS, MOST_CELLS = 20, 24

#: Texts whose shingles a task holds at once.
ROWS = 2000

_BITS = ("u0", "u1", "u2", "u3")


def shared_pairs(df: DataFrame, key: str, grp: str, shingles: str, sketch: int = 60, least: int = 2, most: int = 40, at_least: float = 0.0, words: str | None = None, k: int = 9) -> DataFrame:
    """(a, b, grp_a, grp_b, j): pairs of different groups that share one of their ``sketch`` smallest shingles (16 hex digits each), with their Jaccard value.

    Shingles that fewer than ``least`` or more than ``most`` sketches hold join nothing: that is the operator's
    definition, and it bounds the pairs that one shingle can make. Empty sets make no pair. Pairs under ``at_least``
    are left out; most of them never meet: of two sketches take the one that ends earlier; what its record shares is
    among the useful postings, or among the shingles that it has besides and that stand in no sketch alone. So all but
    a few of the useful postings must be shared, and it looks others up by those few only.

    A pair that has met is dropped if 256 bits of each set tell that too much of one is not in the other. Whole sets are
    not stored; those of the few pairs left are made again. Shuffle files go when their table is written.

    ``words`` names a column with the words of every text in one string, single spaces between: if ``shingles`` are those of
    its runs of ``k`` words, the sketches are made from it, which costs less than a function on every run.
    """
    source = df.select(F.col(key).alias("id"), F.col(grp).alias("grp"), F.col(shingles).alias("s"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    given = source if words is None else df.select(F.col(key).alias("id"), F.col(grp).alias("grp"), F.col(words).alias("s"))
    made = given.mapInArrow(functools.partial(_sketches, sketch, None if words is None else k), f"id {kinds['id']}, grp {kinds['grp']}, n int, {', '.join(f'{c} bigint' for c in _BITS)}, k array<bigint>")
    made = made.withColumn("rid", F.monotonically_increasing_id())  # a step of its own: beside explode it would number postings
    posts = materialise(made.select("rid", "id", "grp", "n", *_BITS, F.explode("k").alias("g")), "postings", tidy=True)
    passes = min(MOST_PASSES, max(1, -(-posts.count() // PASS_ROWS)))
    kept = []
    for p in range(passes):
        part = posts.select("rid", "grp", "n", "g").where(F.pmod("g", F.lit(passes)) == p)
        # Only most + 1 rows of a shingle leave a task, however many sketches hold it.
        few = part.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy("rid"))).where(F.col("_r") <= most + 1)
        few = few.withColumn("m", F.count("*").over(Window.partitionBy("g"))).where(F.col("m") <= most)
        useful = F.col("m") >= max(least, 2)
        few = few.where(useful | (F.col("m") == 1)).select("rid", *[F.when(useful, F.col(c)).alias(c) for c in ("grp", "n", "g", "m")])  # of one alone only the record
        kept.append(materialise(few, "kept", tidy=True))
    alone = _all(kept).where("g is null").groupBy("rid").agg(F.count("*").alias("alone"))
    facts = posts.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("id", "grp", "n", *_BITS)]).join(alone, "rid", "left").fillna(0, ["alone"])
    facts = materialise(facts, "facts", tidy=True)
    release(posts)
    own = Window.partitionBy("rid")
    ranked = _all(kept).where("g is not null").withColumn("_k", F.row_number().over(own.orderBy("m", "g"))).withColumn("kept", F.count("*").over(own)).join(facts.select("rid", "alone"), "rid")
    must = F.greatest(F.lit(1), F.ceil(at_least * F.col("n") - (F.col("n") - F.col("kept") - F.col("alone")) - 1e-9))
    probes = materialise(ranked.where(F.col("_k") <= F.col("kept") - must + 1).select("g", "rid", "grp", "n"), "probes", tidy=True)
    of = lambda x: facts.select(F.col("rid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *_BITS)])
    beyond = lambda x, y: sum(F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(f"{c}_{y}"))) for c in _BITS)
    common = F.least(F.col("n_x") - beyond("x", "y"), F.col("n_y") - beyond("y", "x"))
    near = []
    for p in range(passes):
        a, b = probes.where(F.pmod("g", F.lit(passes)) == p).alias("a"), kept[p].where("g is not null").alias("b")
        met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.rid") != F.col("b.rid")) & (F.col("a.grp") != F.col("b.grp")) & (F.least("a.n", "b.n") >= at_least * F.greatest("a.n", "b.n") - 1e-9))
        pair = met.select(F.least("a.rid", "b.rid").alias("x"), F.greatest("a.rid", "b.rid").alias("y")).distinct().join(of("x"), "x").join(of("y"), "y")
        near.append(materialise(pair.where(common >= at_least / (1 + at_least) * (F.col("n_x") + F.col("n_y")) - 1e-9).select("x", "y"), "near", tidy=True))
        release(kept[p])
    release(probes)
    named = lambda x: facts.select(F.col("rid").alias(x), F.struct("id", "grp").alias(f"of_{x}"))
    pair = _all(near).distinct().join(named("x"), "x").join(named("y"), "y").select(F.least("of_x", "of_y").alias("p"), F.greatest("of_x", "of_y").alias("q"))
    pair = materialise(pair.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.grp").alias("grp_a"), F.col("q.grp").alias("grp_b")), "candidates", tidy=True)
    for t in (*near, facts):
        release(t)
    ids = pair.select(F.col("a").alias("id")).union(pair.select("b")).distinct()
    sets = materialise(source.join(ids, "id", "left_semi").select("id", "s"), "sets", tidy=True)
    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pair.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    j = F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))
    out = materialise(both.select("a", "b", "grp_a", "grp_b", j.alias("j")).where(F.col("j") >= at_least), "pairs", tidy=True)
    release(pair)
    release(sets)
    return out


def near_elsewhere(df: DataFrame, key: str, grp: str, words: str, at_least: float, k: int = 9) -> DataFrame:
    """(text): every different ``text`` (md5 of ``words``) that has a record of another group with Jaccard value ``at_least`` or more; no sketch, and no bound on what a shingle joins.

    ``words`` are the words of a record in one string, single spaces between. Copies are one class, and a class of two groups is
    near by itself. Of two sets that are near each other, ``at_least`` of each is shared, so the first ``n - ceil(at_least n) + 1``
    shingles of both in any common order share one: in the order of rising counts those are few that any other class holds.
    Counts are kept in cells, so a shingle may seem more frequent than it is: that changes the order, not the result.
    """
    text = df.where(F.col(grp).isNotNull()).select(F.col(key).alias("id"), F.col(grp).alias("grp"), F.col(words).alias("words"))
    classes = text.groupBy(F.md5("words").alias("text")).agg(F.min("id").alias("id"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    classes = classes.select("text", "id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only"), F.monotonically_increasing_id().alias("c"))
    classes = materialise(classes, "classes", tidy=True)
    rows = text.select("id", "words").join(classes.select("id", "c", "only"), "id").select("c", "only", "words")
    spark, runs = df.sparkSession, classes.count() * 100
    log = min(MOST_CELLS, max(LEAST_CELLS, runs.bit_length()))
    tallies = rows.select("words").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(functools.partial(_tally, log, k), "j int, x binary")
    tallies = materialise(tallies.groupBy("j").applyInArrow(_levels, "j int, x binary"), "tallies", tidy=True)
    level = np.zeros(1 << log, np.uint8)
    for r in tallies.toArrow().to_pylist():
        level[r["j"] : r["j"] + len(r["x"])] = np.frombuffer(r["x"], np.uint8)
    release(tallies)
    sent = spark.sparkContext.broadcast(level)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _firsts(sent.value, at_least, k, batches)

    posts = materialise(rows.mapInArrow(firsts, "c bigint, only string, n int, g bigint"), "postings", tidy=True)
    sent.destroy()
    passes = min(MOST_PASSES, max(1, -(-posts.count() // PASS_ROWS)))
    near = []
    for p in range(passes):
        part = posts.where(F.pmod("g", F.lit(passes)) == p)
        a, b = part.alias("a"), part.alias("b")
        close = F.least("a.n", "b.n") >= at_least * F.greatest("a.n", "b.n") - 1e-9
        met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.c") < F.col("b.c")) & ~F.col("a.only").eqNullSafe(F.col("b.only")) & close)
        near.append(materialise(met.select(F.col("a.c").alias("x"), F.col("b.c").alias("y")).distinct(), "near", tidy=True))
    release(posts)
    pair = materialise(_all(near).distinct(), "candidates", tidy=True)
    for t in near:
        release(t)
    both = pair.select(F.col("x").alias("c")).union(pair.select("y")).distinct()
    sets = materialise(rows.join(both, "c", "left_semi").select("c", "words").mapInArrow(functools.partial(_sets_of, k), "c bigint, s array<bigint>"), "sets", tidy=True)
    of = lambda v: sets.select(F.col("c").alias(v), F.col("s").alias(f"s{v}"))
    common = F.size(F.array_intersect("sx", "sy"))
    found = pair.join(of("x"), "x").join(of("y"), "y").withColumn("common", common).where(F.col("common") / (F.size("sx") + F.size("sy") - F.col("common")) >= at_least)
    found = materialise(found.select(F.explode(F.array("x", "y")).alias("c")).distinct(), "found", tidy=True)
    out = materialise(classes.where("only is null").select("text").union(classes.where("only is not null").join(found, "c", "left_semi").select("text")), "hits", tidy=True)
    for t in (pair, sets, found, classes):
        release(t)
    return out


def _numbers(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the sets of the texts' shingles, their numbers one set after the other)."""
    parts = [_hashes(t, k) for t in texts]
    return np.array([len(x) // 8 for x in parts], np.int64), np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)


def _tally(log: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold a shingle of each of ``2 ** log`` cells, 65,535 at most, in pieces (first cell, counts)."""
    count, piece = np.zeros(1 << log, np.uint16), 1 << 20
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            _, g = _numbers(b.column(0)[at : at + ROWS].to_pylist(), k)
            cell, more = np.unique(g >> np.uint64(64 - log), return_counts=True)
            cell = cell.astype(np.int64)
            count[cell] = np.minimum(count[cell] + more, 65_535)
    for j in range(0, len(count), piece):
        if count[j : j + piece].any():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([count[j : j + piece].tobytes()], pa.binary())], ["j", "x"])


def _levels(t: pa.Table) -> pa.Table:
    """The sum of the counts of one piece as eighths of a doubling."""
    count = np.sum([np.frombuffer(x.as_py(), np.uint16) for x in t["x"]], axis=0, dtype=np.int64)
    return pa.table({"j": t["j"][:1], "x": pa.array([np.round(8 * np.log2(1 + count)).astype(np.uint8).tobytes()], pa.binary())})


def _firsts(level: np.ndarray, at_least: float, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (c, only, words): (c, only, n, g) for those first shingles in rising order of (level, number) of which a set near it must hold one; those of a cell that no other set is in are left out."""
    log, alone = len(level).bit_length() - 1, round(8 * np.log2(2))
    for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
        n, g = _numbers(b.column(2).to_pylist(), k)
        row = np.repeat(np.arange(len(n)), n)
        at = level[(g >> np.uint64(64 - log)).astype(np.int64)]
        order = np.lexsort((g, at, row))
        need = (n - np.ceil(at_least * n - 1e-9) + 1).astype(np.int64)
        first = order[(np.arange(len(g)) - (np.cumsum(n) - n)[row] < need[row]) & (at[order] > alone)]
        of = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(n[row[first]], pa.int32()), pa.array(g[first].view(np.int64))], ["c", "only", "n", "g"])


def _sets_of(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (c, words): (c, the numbers of its shingles)."""
    for b in batches:
        n, g = _numbers(b.column(1).to_pylist(), k)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(g.view(np.int64)))], ["c", "s"])


def _hashes(text: str, k: int) -> bytes:
    """The first 8 bytes of the md5 of every run of ``k`` words, each once."""
    raw = text.encode("utf-8", "surrogatepass")
    begin = [0]
    at = raw.find(b" ")
    while at >= 0:
        begin.append(at + 1)
        at = raw.find(b" ", at + 1)
    begin.append(len(raw) + 1)
    return b"".join({md5(raw[begin[i] : begin[min(i + k, len(begin) - 1)] - 1]).digest()[:8] for i in range(max(1, len(begin) - k))})


def _sketches(sketch: int, k: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (id, grp, s): (id, grp, size, 256 bits that ``s`` sets, its ``sketch`` smallest as numbers). ``s``: hex digits, or a text of which runs of ``k`` words are hashed."""
    digit = np.zeros(256, np.uint64)
    for i, c in enumerate("0123456789abcdef"):
        digit[ord(c)] = i
    for b in batches:
        if k is not None:
            parts = [_hashes(t, k) for t in b.column(2).to_pylist()]
            n = np.array([len(x) // 8 for x in parts], np.int64)
            g = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
        else:
            n = np.nan_to_num(b.column(2).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            raw = np.frombuffer("".join(b.column(2).flatten().to_pylist()).encode("ascii"), np.uint8).reshape(-1, 16)
            g = np.zeros(len(raw), np.uint64)
            for c in range(16):
                g = (g << np.uint64(4)) | digit[raw[:, c]]
        row = np.repeat(np.arange(len(n)), n)
        bits = np.zeros((len(n), 256), bool)
        bits[row, (g & np.uint64(255)).astype(np.int64)] = True
        words = np.packbits(bits, axis=1).view(np.int64)
        g = g[np.lexsort((g, row))]
        first = g[np.arange(len(g)) - (np.cumsum(n) - n)[row] < sketch]
        ends = np.concatenate([[0], np.cumsum(np.minimum(n, sketch))]).astype(np.int32)
        smallest = pa.ListArray.from_arrays(pa.array(ends), pa.array(first.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), *[pa.array(words[:, i].copy()) for i in range(len(_BITS))], smallest], ["id", "grp", "n", *_BITS, "k"])


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def involved(pairs: DataFrame) -> DataFrame:
    """(id): every record of a pair, once."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def later_of_pair(pairs: DataFrame) -> DataFrame:
    """(id): the later record of every pair, once."""
    return pairs.select(F.greatest("a", "b").alias("id")).distinct()
