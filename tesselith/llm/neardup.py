"""Problem 7: provisions that are lightly changed versions of each other.

Token-group matrix. Texts with a similar set of rare phrases form groups (the smallest hash of their prefix
phrases); the matrix holds, phrase by phrase, the groups whose union of prefix phrases contains it. Every text
is a query: it is looked up in the matrix, its overlap with each group's union is counted and bounded by size
and place, and only groups that can hold a partner are opened, where the whole sets of phrases are compared.

Phrases are ordered from rare to common (any fixed order is right). Two sets with a Jaccard value of at least t
have at least ceil(t * larger) phrases in common, so their prefixes of n - ceil(t * n) + HITS phrases share at
least HITS of them (or all that they have to share): no pair is lost. Exact copies are one class; classes are
compared, and pairs of records are formed only for the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.llm import phrases as ph
from tesselith.llm.grouping import components
from tesselith.plans.lineage import materialise, release
from tesselith.plans.sizing import small
from tesselith.sources.tables import table

THRESHOLD = 0.6

#: Prefix phrases that a pair must share before its group is opened.
HITS = 6

#: Entries of one bucket of the matrix, texts of one packed block, classes and queries of one opened piece of a group.
BUCKET, BLOCK, PIECE = 500_000, 50_000, 4096

#: Phrases of the texts that one task compares when groups are opened.
OPENED = 2_000_000

#: Lookups that are held at once.
HELD = 2_000_000

_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def prefix(sketch, g: np.ndarray, doc: np.ndarray, n_docs: int, t: float, hits: int):
    """Prefix phrases that some other text may hold: (phrase, text, place, level), and the group half of each text's key."""
    level = ph.commonness(sketch, g)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(48)) | (level.astype(np.uint64) << np.uint64(40)) | (g >> np.uint64(8)), kind="stable")
    g, doc, level = g[order], doc[order], level[order]
    n = np.bincount(doc, minlength=n_docs)
    place = np.arange(len(g)) - np.searchsorted(doc, np.arange(n_docs))[doc]
    keep = (place < (n - _ceil(t * n) + hits)[doc]) & (level > 0)
    g, doc, place, level = g[keep], doc[keep], place[keep], level[keep]
    group = np.full(n_docs, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(group, doc, ph.mix(g ^ np.uint64(0x5851F42D4C957F2D)) >> _HALF)
    return g, doc, place, level, group


def _pack(token: np.ndarray, local: np.ndarray, place: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> bytes:
    """A block of one bucket: the texts it names, then its entries by phrase (differences by byte planes, which compress well)."""
    used, local = np.unique(local, return_inverse=True)
    order = np.argsort(token, kind="stable")
    step = np.diff(token[order], prepend=np.uint32(0)).astype(np.uint32)
    planes = step.view(np.uint8).reshape(-1, 4).T.tobytes()
    body = [planes, local[order].astype(np.uint16).tobytes(), place[order].astype(np.uint16).tobytes(), keys[used].tobytes(), sizes[used].astype(np.uint32).tobytes()]
    return np.array([len(token), len(used)], np.int64).tobytes() + zlib.compress(b"".join(body), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, u = np.frombuffer(data[:16], np.int64)
    raw, at = zlib.decompress(data[16:]), 0

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    step = take(np.uint8, 4 * m).reshape(4, -1).T.copy().view(np.uint32).ravel()
    local, place = take(np.uint16, m), take(np.uint16, m)
    keys, sizes = take(np.uint64, u), take(np.uint32, u)
    return np.cumsum(step, dtype=np.uint32), keys[local], sizes[local].astype(np.int64), place.astype(np.int64)


def _matrix_hits(token, key, size, place, asks, t: float, hits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lookups of every query in one bucket of the matrix: (query key, group, phrases that may count).

    Entries that do not ask are there as members only; they ask in another part of the phrase's bucket. Only groups numbered at most as the query's own are looked up, so two texts of different groups meet once.
    """
    order = np.lexsort((~asks, key, token))
    token, key, size, place, asks = token[order], key[order], size[order], place[order], asks[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])  # copies of one class
    token, key, size, place, asks = token[keep], key[keep], size[keep], place[keep], asks[keep]
    group = key >> _HALF
    # Matrix rows of this bucket: the members of a group that hold the phrase, with the range of their sizes and places.
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    at = np.nonzero(new)[0]
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    low, high = np.minimum.reduceat(size, at), np.maximum.reduceat(size, at)
    left = np.maximum.reduceat(size - 1 - place, at)
    members = np.diff(np.append(at, len(token)))
    m_token, m_group = token[at], group[at]
    row_of = np.cumsum(new) - 1
    first = np.searchsorted(m_token, token)  # first matrix row of the phrase; rows up to the query's own qualify
    count = np.where(asks, row_of - first + 1, 0)
    ends = np.cumsum(count)
    held: list[tuple] = []
    n_held = lo = 0
    while lo < len(token):
        to = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD, "right")))
        c = count[lo:to]
        q = np.repeat(np.arange(lo, to), c)
        r = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c) + first[q]
        ok = (r != row_of[q]) | (members[r] > 1)
        q, r = q[ok], r[ok]
        nq = size[q]
        closest = np.clip(nq, low[r], high[r])
        need = _ceil(t / (1 + t) * (nq + low[r]))
        ok = (np.minimum(nq, closest) >= t * np.maximum(nq, closest) - 1e-9) & (hits + np.minimum(nq - 1 - place[q], left[r]) >= need)
        held.append((key[q[ok]], m_group[r[ok]], np.ones(int(ok.sum()), np.int64)))
        n_held += len(held[-1][0])
        if n_held > HELD:
            held = [_count(*(np.concatenate(x) for x in zip(*held)))]
            n_held = 0
        lo = to
    return _count(*(np.concatenate(x) for x in zip(*held)))


def _count(q: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((g, q))
    q, g = q[order], g[order]
    n = np.ones(len(q), np.int64) if n is None else n[order]
    if not len(q):
        return q, g, n
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (g[1:] != g[:-1])
    at = np.nonzero(new)[0]
    return q[at], g[at], np.add.reduceat(n, at)


def qualify(texts: DataFrame, key: str, text: str, t: float, hits: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(texts with phrases: key, c1, c2, n, code; qualifying pairs: code of the query, group, hits; the table behind both; partitions for whole sets)."""
    spark = texts.sparkSession
    sketch, total = ph.survey(texts, text)
    parts = ph.exchange_parts(spark, int(total * (1 - t)) + 1, BUCKET)
    names_of, hot = ph.even_names(spark, parts), ph.HOT
    kind = texts.schema[key].dataType.simpleString()
    columns = ["bucket", "data", "key", "c1", "c2", "n", "code"]
    kinds = f"bucket int, data binary, key {kind}, c1 bigint, c2 bigint, n int, code bigint"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush():
            token, place, level = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
            local, keys, sizes = (np.concatenate([h[i] for h in held]) for i in (1, 4, 5))
            # Copies of one text in a block stand for each other.
            one = np.zeros(len(keys), bool)
            one[np.unique(keys, return_index=True)[1]] = True
            keep = one[local]
            token, place, local, split = token[keep], place[keep], local[keep], ph.hot_parts(level[keep], hot)
            # A hot phrase is a member in every part of its bucket and asks in one.
            at = np.repeat(np.arange(len(token)), split)
            part = np.arange(len(at)) - np.repeat(np.cumsum(split) - split, split)
            asks = part == (ph.mix(keys[local[at]]) % split[at].astype(np.uint64)).astype(np.int64)
            token, local, place = token[at], local[at], place[at].astype(np.uint16) | np.where(asks, 0, 0x8000).astype(np.uint16)
            bucket = ph.bucket_of(token, part, parts)
            data, names = [], []
            for b in np.unique(bucket):
                s = bucket == b
                names.append(int(names_of[b, 0]))
                data.append(_pack((token[s] & _LOW).astype(np.uint32), local[s], place[s], keys, sizes))
            none = [pa.nulls(len(data), k) for k in (id_type, pa.int64(), pa.int64(), pa.int32(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary()), *none], columns)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            all_texts = b.column(1).to_pylist()
            for lo, hi in ph.chunks(all_texts):
                m = hi - lo
                g, doc, _ = ph.phrases(all_texts[lo:hi])
                g, doc = ph.distinct(g, doc)
                c1, c2, size = ph.identity(g, doc, m)
                pg, pdoc, place, level, group = prefix(sketch, g, doc, m, t, hits)
                code = (group << _HALF) | (c1 & _LOW)
                some = np.nonzero(size)[0]
                if not len(some):
                    continue
                ids = b.column(0).slice(lo, m).take(pa.array(some))
                spread = names_of[np.arange(len(some)) % parts, 1]  # copies of one text spread too
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread, pa.int32()), pa.nulls(len(some), pa.binary()), ids, pa.array(c1[some].view(np.int64)), pa.array(c2[some].view(np.int64)),
                     pa.array(size[some].astype(np.int32)), pa.array(code[some].view(np.int64))], columns)
                # Places beyond 15 bits count as the last one that fits: the bound is looser, never wrong.
                held.append((pg, pdoc + count, np.minimum(place, 0x7FFF), level, code, size))
                count += m
                if count > BLOCK - 10_000:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def look_up(key_: tuple, rows: pa.Table) -> pa.Table:
        if rows.column("data").null_count:  # texts, under their own names
            return rows
        blocks = [_unpack(d.as_py()) for d in rows.column("data")]
        token, code, size, place = (np.concatenate(x) for x in zip(*blocks))
        q, g, n = _matrix_hits(token, code, size, place & 0x7FFF, place < 0x8000, t, hits)
        to = ph.mix(q) % np.uint64(parts)
        data, names = [], []
        for b in np.unique(to):
            s = to == b
            names.append(int(names_of[int(b), 0]))
            data.append(np.array([s.sum()], np.int64).tobytes() + q[s].tobytes() + g[s].astype(np.uint32).tobytes() + np.minimum(n[s], 255).astype(np.uint8).tobytes())
        none = [pa.nulls(len(data), rows.schema.field(i).type) for i in range(2, 7)]
        return pa.Table.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary()), *none], names=columns)

    seen = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(build, kinds).repartition(parts, "bucket").groupBy("bucket").applyInArrow(look_up, kinds)
    seen = materialise(seen, "matrix", tidy=True)
    docs = seen.where("data is null").select("key", "c1", "c2", "n", "code")

    def decide(key_: tuple, rows: pa.Table) -> pa.Table:
        q, g, n = [], [], []
        for d in rows.column("data"):
            raw = d.as_py()
            m = int(np.frombuffer(raw[:8], np.int64)[0])
            q.append(np.frombuffer(raw, np.uint64, m, 8))
            g.append(np.frombuffer(raw, np.uint32, m, 8 + 8 * m).astype(np.uint64))
            n.append(np.frombuffer(raw, np.uint8, m, 8 + 12 * m).astype(np.int64))
        q, g, n = _count(np.concatenate(q), np.concatenate(g), np.concatenate(n))
        return pa.table({"code": q.view(np.int64), "grp": g.astype(np.int64), "hits": n})

    counted = seen.where("data is not null").select("bucket", "data").repartition(parts, "bucket").groupBy("bucket").applyInArrow(decide, "code bigint, grp bigint, hits bigint")
    return docs, counted, seen, ph.exchange_parts(spark, total, OPENED)


def open_groups(texts: DataFrame, key: str, text: str, classes: DataFrame, wanted: DataFrame, t: float, tasks: int) -> DataFrame:
    """(a, b, common, n_a, n_b): the pairs of class representatives with a Jaccard value of at least ``t``.

    ``wanted``: (code, grp). A group of many classes or queries is opened in pieces: a task holds PIECE of each at most, about.
    """
    opened = wanted.select("grp").distinct().join(classes.select("grp", "rep"), "grp")
    asking = wanted.join(classes.select("code", "rep"), "code").select("grp", "rep")
    cuts = lambda d, name: d.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(PIECE)).cast("int").alias(name))
    pieces = cuts(opened, "pieces").join(cuts(asking, "chunks"), "grp")
    slot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = opened.join(pieces, "grp").select("rep", "grp", slot("pieces").alias("piece"), every("chunks").alias("chunk"), F.lit(False).alias("asks"))
    query = asking.join(pieces, "grp").select("rep", "grp", every("pieces").alias("piece"), slot("chunks").alias("chunk"), F.lit(True).alias("asks"))
    roles = materialise(member.unionByName(query), "roles", tidy=True)
    reps = small(roles.select(F.col("rep").alias(key)).distinct())
    kind = texts.schema[key].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = b.column(1).to_pylist()
            for lo, hi in ph.chunks(all_texts):
                g, doc, _ = ph.phrases(all_texts[lo:hi])
                g, doc = ph.distinct(g, doc)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                data = [g[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(data, pa.binary())], ["rep", "phrases"])

    whole = texts.join(reps, key, "left_semi").select(key, text).mapInArrow(sets, f"rep {kind}, phrases binary")

    def compare(key_: tuple, rows: pa.Table) -> pa.Table:
        sets_, asks, holds = {}, set(), set()
        for rep, data, ask in zip(rows.column("rep").to_pylist(), rows.column("phrases"), rows.column("asks").to_pylist()):
            sets_[rep] = data  # deliveries of one record are equal
            (asks if ask else holds).add(rep)
        sets_ = {k: np.frombuffer(v.as_py(), np.uint64) for k, v in sets_.items()}
        names = sorted(holds)
        size = np.array([len(sets_[m]) for m in names], np.int64)
        every = np.concatenate([sets_[m] for m in names]) if names else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(names)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        out: list[tuple] = []
        for a in sorted(asks):
            p = sets_[a]
            lo, hi = np.searchsorted(every, p, "left"), np.searchsorted(every, p, "right")
            if np.count_nonzero(hi > lo) < t * len(p) - 1e-9:  # overlap with the union of the group
                continue
            c = hi - lo
            at = np.repeat(lo, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            common = np.bincount(owner[at], minlength=len(names))
            for i in np.nonzero((common >= t * (len(p) + size - common) - 1e-9) & (common > 0))[0]:
                b = names[i]
                if b != a and not (b in asks and a in holds and b < a):
                    out.append((min(a, b), max(a, b), int(common[i]), len(sets_[min(a, b)]), len(sets_[max(a, b)])))
        cols = list(zip(*out)) if out else [[]] * 5
        t_ = rows.schema.field("rep").type
        return pa.table({"a": pa.array(cols[0], t_), "b": pa.array(cols[1], t_), "common": pa.array(cols[2], pa.int64()), "n_a": pa.array(cols[3], pa.int64()), "n_b": pa.array(cols[4], pa.int64())})

    if (sent := small(roles)) is roles:  # too many to broadcast
        whole, sent = whole.repartition(tasks, "rep"), roles.repartition(tasks, "rep")
    both = whole.join(sent, "rep").repartition(tasks, "grp", "piece", "chunk")
    links = materialise(both.groupBy("grp", "piece", "chunk").applyInArrow(compare, f"a {kind}, b {kind}, common bigint, n_a bigint, n_b bigint").distinct(), "links", tidy=True)
    release(roles)
    return links


def similar(texts: DataFrame, key: str = "provision_id", text: str = "text", t: float = THRESHOLD, hits: int = HITS) -> tuple[DataFrame, DataFrame]:
    """(links between class representatives: a, b, common, n_a, n_b; members: key, rep).

    Texts under 30 words and null or blank ones have no phrases and are in neither table. Rows with null keys
    are left out; a key delivered twice is one record. Records with equal sets of phrases are one class, named
    by its smallest key. An empty table gives empty tables; extra columns are ignored.
    """
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key), F.col(text))
    docs, counted, seen, tasks = qualify(rows, key, text, t, hits)
    # Sets that have fewer than HITS phrases to share need only these.
    classes = materialise(docs.groupBy("c1", "c2", "code").agg(F.min("key").alias("rep"), F.min("n").alias("n")).withColumn("grp", F.shiftrightunsigned("code", 32)), "classes", tidy=True)
    short = classes.where(F.col("n") < hits / t).select("code").distinct()
    wanted = counted.where(F.col("hits") >= hits).select("code", "grp").unionByName(counted.where(F.col("hits") < hits).join(short, "code", "left_semi").select("code", "grp"))
    wanted = materialise(wanted, "wanted", tidy=True)
    rep = classes.groupBy("c1", "c2").agg(F.min("rep").alias("rep"))
    members = materialise(docs.join(rep, ["c1", "c2"]).select(F.col("key").alias(key), "rep").distinct(), "members", tidy=True)
    release(seen)  # the lookups go before the sets of phrases are written
    links = open_groups(rows, key, text, classes, wanted, t, tasks)
    for done in (classes, wanted):
        release(done)
    return links, members


def expand(links: DataFrame, members: DataFrame, end: str, name: str, key: str = "key", most: int = PIECE) -> DataFrame:
    """``links`` with ``name``: every member (key, rep) of the class at ``end``, whose column goes. A class of more than ``most`` members is joined in pieces."""
    big = members.groupBy("rep").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_n")).where("_n > 1")
    cut = members.join(big, "rep", "left").select(F.col("rep").alias(end), F.col(key).alias(name), F.pmod(F.xxhash64(key), F.coalesce("_n", F.lit(1))).cast("int").alias("_s"))
    spread = links.join(big.withColumnRenamed("rep", end), end, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return spread.join(cut, [end, "_s"]).drop(end, "_s")


def pairs(links: DataFrame, members: DataFrame, key: str = "provision_id") -> DataFrame:
    """Every pair of records (key_a < key_b) of linked classes and of one class."""
    inside = members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("same"))
    both = expand(expand(links.select("a", "b", F.lit(False).alias("same")).unionByName(inside), members, "a", "x", key), members, "b", "y", key).where("not same or x < y")
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus").select("provision_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of provisions that are lightly changed versions of each other."""
    return pairs(*similar(_corpus(spark, sf_dir)))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per provision with a partner: its class, the group that links form, and the links of its class."""
    links, members = similar(_corpus(spark, sf_dir))
    group = components(links)
    degree = links.select(F.col("a").alias("rep")).unionAll(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    size = members.groupBy("rep").agg(F.count("*").alias("class_size"))
    return (
        members.join(size, "rep").join(degree, "rep", "left").join(group.withColumnRenamed("v", "rep"), "rep", "left")
        .where("class_size > 1 or n_links is not null")
        .select("provision_id", F.col("rep").alias("class_id"), "class_size", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )


_PAIRS = """
WITH RECURSIVE one AS (SELECT provision_id, regexp_extract_all(lower(min(text)), '[a-z0-9]+') w FROM corpus WHERE provision_id IS NOT NULL GROUP BY 1),
p AS (SELECT provision_id, unnest(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) g FROM one WHERE len(w) >= 30),
n AS (SELECT provision_id, count(*) n FROM p GROUP BY 1),
c AS (SELECT x.provision_id a, y.provision_id b, count(*) c FROM p x JOIN p y ON x.g = y.g AND x.provision_id < y.provision_id GROUP BY 1, 2),
f AS (SELECT a, b, c.c = na.n AND c.c = nb.n AS same FROM c JOIN n na ON na.provision_id = a JOIN n nb ON nb.provision_id = b WHERE c.c >= 0.6 * (na.n + nb.n - c.c))
"""

SQL = {
    "p7_found": _PAIRS + "SELECT a AS provision_id_a, b AS provision_id_b FROM f",
    "p7_groups": _PAIRS
    + """, m AS (SELECT n.provision_id v, coalesce(min(f.a), n.provision_id) rep FROM n LEFT JOIN f ON f.b = n.provision_id AND f.same GROUP BY n.provision_id), s AS (SELECT rep, count(*) k FROM m GROUP BY 1),
l AS (SELECT DISTINCT x.rep a, y.rep b FROM f JOIN m x ON x.v = f.a JOIN m y ON y.v = f.b WHERE NOT f.same), t AS (SELECT a, b FROM l UNION SELECT b, a FROM l), g AS (SELECT a, count(DISTINCT b) k FROM t GROUP BY 1),
r(v, w) AS (SELECT a, a FROM t UNION SELECT r.v, t.b FROM r JOIN t ON t.a = r.w), q AS (SELECT v, min(w) w FROM r GROUP BY 1)
SELECT m.v AS provision_id, m.rep AS class_id, s.k AS class_size, coalesce(q.w, m.rep) AS group_id, coalesce(g.k, 0) AS n_links FROM m JOIN s ON s.rep = m.rep LEFT JOIN g ON g.a = m.rep LEFT JOIN q ON q.v = m.rep WHERE s.k > 1 OR g.k IS NOT NULL
""",
}
