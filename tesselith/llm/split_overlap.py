"""Problem 2: provisions of evaluation documents that recur in training documents.

Winnowing fingerprints. Phrases are ordered from rare to common; of two phrases that follow each other the rarer is a
fingerprint. Training texts give all their fingerprints, and each phrase whose first or last four words stand elsewhere
in the text too. Evaluation texts give the fingerprints of disjoint pairs of phrases that follow each other and stand
nowhere before. If a training text has both phrases of such a pair, they follow each other there too, or the four words
between them stand at two places: the pair's fingerprint is given either way. At least 80 % of an evaluation text's
phrases must be found, so at most B = floor(n / 5) are missing, each spoils one pair, and among any B + k pairs k are
whole: only the B + k rarest are looked up, and k of them must meet in a training text that is long enough. Texts that
repeat themselves so much that they have no B + 1 pairs are looked up by all their phrases in a second pass. Candidates
are then aligned: seeds are chained collinearly and the chain is extended phrase by phrase; where it covers too little,
whole sets decide.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.llm import phrases as ph
from tesselith.llm.neardup import expand
from tesselith.llm.proportions import plain
from tesselith.plans.lineage import materialise, release
from tesselith.plans.sizing import small
from tesselith.sources.tables import table

CONTAINED = 0.8
WINDOW = 2

#: Looked-up fingerprints that must meet, where the evaluation text is long enough to ask for so many.
MEETINGS = 6

#: Entries of one bucket of the exchange, texts of one packed block.
BUCKET, BLOCK = 400_000, 60_000

_LOW = np.uint64(0xFFFFFFFF)


def _rank_keys(sketch, g: np.ndarray) -> np.ndarray:
    return (ph.commonness(sketch, g).astype(np.uint64) << np.uint64(56)) | (g << np.uint64(8))


def fingerprints(keys: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the rarest phrase of every window that lies in one text, without repeats."""
    if len(keys) < window:
        return np.empty(0, np.int64)
    n = len(keys) - window + 1
    at, low = np.arange(n), keys[:n]
    for k in range(1, window):
        less = keys[k : n + k] < low
        at, low = np.where(less, np.arange(k, n + k), at), np.where(less, keys[k : n + k], low)
    found = np.zeros(len(keys), bool)
    found[at[doc[:n] == doc[window - 1 :]]] = True
    return np.nonzero(found)[0]


def probes(keys: np.ndarray, doc: np.ndarray, place: np.ndarray, n_docs: int, contained: float = CONTAINED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(indices to look up, meetings asked of each text); a text that asks for 0 has phrases, but too few windows.

    Every phrase of a text stands once in ``keys``, by its first ``place``; a window is one phrase, or two whose places follow each other.
    """
    count = np.bincount(doc, minlength=n_docs)
    missing = np.floor((1 - contained) * count + 1e-9).astype(np.int64)
    if window == 1:
        start = best = np.arange(len(keys))
    else:
        follows = np.zeros(len(keys), bool)
        follows[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1)
        begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(keys)))) if len(keys) else np.empty(0, np.int64)
        start = np.nonzero(((np.arange(len(keys)) - begin) % 2 == 0)[:-1] & follows[1:])[0]
        best = start + (keys[start + 1] < keys[start])
    owner = doc[start]
    windows = np.bincount(owner, minlength=n_docs)
    asked = np.where(count > 0, np.clip(windows - missing, 0, MEETINGS), 0)
    best = best[np.lexsort((keys[best], owner))]
    nth = np.arange(len(best)) - np.searchsorted(owner, np.arange(n_docs))[owner]
    return best[(nth < (missing + asked)[owner]) & (asked[owner] > 0)], asked


def _pack(token: np.ndarray, local: np.ndarray, codes: np.ndarray, asked: np.ndarray, sizes: np.ndarray) -> bytes:
    used, local = np.unique(local, return_inverse=True)
    order = np.argsort(token, kind="stable")
    step = np.diff(token[order], prepend=np.uint32(0)).astype(np.uint32)
    body = [step.view(np.uint8).reshape(-1, 4).T.tobytes(), local[order].astype(np.uint16).tobytes(), codes[used].astype(np.uint32).tobytes(), sizes[used].astype(np.uint32).tobytes(), asked[used].astype(np.uint8).tobytes()]
    return np.array([len(token), len(used)], np.int64).tobytes() + zlib.compress(b"".join(body), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    m, u = (int(x) for x in np.frombuffer(data[:16], np.int64))
    raw = zlib.decompress(data[16:])
    step = np.frombuffer(raw, np.uint8, 4 * m).reshape(4, -1).T.copy().view(np.uint32).ravel()
    local = np.frombuffer(raw, np.uint16, m, 4 * m)
    codes, sizes = np.frombuffer(raw[6 * m : 6 * m + 8 * u], np.uint32).reshape(2, -1)
    asked = np.frombuffer(raw, np.uint8, u, 6 * m + 8 * u)
    return np.cumsum(step, dtype=np.uint32), codes[local], asked[local], sizes[local].astype(np.int64)


def _count(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _meet(token: np.ndarray, code: np.ndarray, asked: np.ndarray, size: np.ndarray, contained: float) -> tuple[np.ndarray, np.ndarray]:
    """(evaluation code << 32 | training code, fingerprints that both have) where the training text is long enough."""
    half = np.uint64(32)
    both = (token.astype(np.uint64) << half) | code

    def side(of: np.ndarray, widest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (token, code), and the size of each code (of sets with one code the one that excludes least)."""
        known = np.unique((code[of].astype(np.uint64) << half) | size[of].astype(np.uint64))
        c = known >> half
        at = np.nonzero(np.concatenate([c[1:] != c[:-1], [True]] if widest else [[True], c[1:] != c[:-1]]))[0] if len(c) else np.empty(0, np.int64)
        rows = np.unique(both[of])
        mine = rows & _LOW
        return rows >> half, mine, (known[at] & _LOW).astype(np.int64)[np.searchsorted(c[at], mine)] if len(at) else np.empty(0, np.int64)

    t_token, t_code, t_size = side(asked == 0, True)
    q_token, q_code, q_size = side(asked > 0, False)
    lo, hi = np.searchsorted(t_token, q_token, "left"), np.searchsorted(t_token, q_token, "right")
    count = hi - lo
    ends = np.cumsum(count)
    held, n_held, done, at = [], 0, [], 0
    while at < len(q_token):  # in pieces of a bounded number of meetings
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
        c = count[at:to]
        q = np.repeat(np.arange(at, at + len(c)), c)
        r = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c) + lo[q]
        ok = t_size[r] >= contained * q_size[q] - 1e-9
        held.append((q_code[q[ok]] << half) | t_code[r[ok]])
        n_held += len(held[-1])
        if n_held > 4_000_000:
            done.append(_count(np.concatenate(held)))
            held, n_held = [], 0
        at = to
    if held:
        done.append(_count(np.concatenate(held)))
    if not done:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _count(*(np.concatenate(x) for x in zip(*done))) if len(done) > 1 else done[0]


def _pack_pairs(keys: np.ndarray, n: np.ndarray, asked: np.ndarray) -> bytes:
    """Sorted pairs as differences by byte planes; ``asked`` stands for each evaluation text."""
    step = np.diff(keys, prepend=np.uint64(0))
    body = [step.view(np.uint8).reshape(-1, 8).T.tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), asked.astype(np.uint8).tobytes()]
    return np.array([len(keys)], np.int64).tobytes() + zlib.compress(b"".join(body), 1)


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = int(np.frombuffer(data[:8], np.int64)[0])
    raw = zlib.decompress(data[8:])
    step = np.frombuffer(raw, np.uint8, 8 * m).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64), np.frombuffer(raw, np.uint8, m, 8 * m).astype(np.int64), np.frombuffer(raw, np.uint8, m, 9 * m)


def candidates(texts: DataFrame, contained: float = CONTAINED, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``texts``: key, text, asks (in an evaluation split). (texts with phrases: key, asks, c1, c2, code, wide; candidates: code_a, code_b; the table behind both).

    ``wide`` are evaluation texts that had too few windows and were not looked up.
    """
    spark = texts.sparkSession
    sketch, total = ph.survey(texts, "text")
    parts = ph.exchange_parts(spark, total // 3 + 1, BUCKET)
    names_of, hot = ph.even_names(spark, parts), ph.HOT
    kind = texts.schema["key"].dataType.simpleString()
    columns = ["bucket", "data", "key", "asks", "c1", "c2", "code", "wide"]
    kinds = f"bucket int, data binary, key {kind}, asks boolean, c1 bigint, c2 bigint, code bigint, wide boolean"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, id_type = 0, None

        def flush() -> pa.RecordBatch:
            token, local, codes, asked, sizes, level = (np.concatenate([h[i] for h in held]) for i in range(6))
            # Copies of one text in a block stand for each other.
            same = np.stack([(codes << np.uint64(32)) | sizes.astype(np.uint64), (asked > 0).astype(np.uint64)])
            one = np.zeros(len(codes), bool)
            one[np.unique(same, axis=1, return_index=True)[1]] = True
            keep = one[local]
            token, local, split = token[keep], local[keep], ph.hot_parts(level[keep], hot)
            # A hot phrase of a training text is in one part of its bucket, one that is looked up, which is rarer, in every part.
            asks = asked[local] > 0
            own = (ph.mix(codes[local]) % split.astype(np.uint64)).astype(np.int64)
            times = np.where(asks, split, 1)
            at = np.repeat(np.arange(len(token)), times)
            part = np.where(asks[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), own[at])
            token, local = token[at], local[at]
            bucket = ph.bucket_of(token, part, parts)
            held_in = [int(b) for b in np.unique(bucket)]
            data = [_pack((token[s] & _LOW).astype(np.uint32), local[s], codes, asked, sizes) for s in (bucket == b for b in held_in)]
            none = [pa.nulls(len(data), k) for k in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array([int(names_of[b, 0]) for b in held_in], pa.int32()), pa.array(data, pa.binary()), *none], columns)

        for b in batches:
            id_type = b.schema.field(0).type
            all_texts, all_asks = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), bool)
            for lo, hi in ph.chunks(all_texts):
                m = hi - lo
                g, doc, _, turns = ph.phrases_and_turns(all_texts[lo:hi])
                c1, c2, size = ph.identity(*ph.distinct(g, doc), m)
                code = c1 & _LOW  # equal codes of different sets only add candidates
                some = np.nonzero(size)[0]
                if not len(some):
                    continue
                keys, asks = _rank_keys(sketch, g), all_asks[lo:hi]
                trains, first = np.nonzero(~asks[doc])[0], ph.firsts(g, doc)
                first = first[asks[doc[first]]]
                found, asked = probes(keys[first], doc[first], first, m, contained, window)
                given = np.zeros(len(g), bool)
                given[trains[fingerprints(keys[trains], doc[trains], window)]] = True
                given[trains] |= turns[trains]
                given[first[found]] = True
                at = np.nonzero(given & (keys >> np.uint64(56) > 0))[0]  # a phrase of one text alone meets nothing
                ids = b.column(0).slice(lo, m).take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names_of[np.arange(len(some)) % parts, 1], pa.int32()), pa.nulls(len(some), pa.binary()), ids, pa.array(asks[some]), pa.array(c1[some].view(np.int64)),
                     pa.array(c2[some].view(np.int64)), pa.array(code[some].view(np.int64)), pa.array(asks[some] & (asked[some] == 0))], columns)
                held.append((g[at], doc[at] + count, code, np.where(asks, asked, 0), size, (keys[at] >> np.uint64(56)).astype(np.uint8)))
                count += m
                if count > BLOCK - 10_000:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def meet(key_: tuple, rows: pa.Table) -> pa.Table:
        if rows.column("data").null_count:  # texts, under their own names
            return rows
        token, code, asked, size = (np.concatenate(x) for x in zip(*[_unpack(d.as_py()) for d in rows.column("data")]))
        keys, n = _meet(token, code, asked, size, contained)
        # The least meetings asked by a text of each code.
        ask_code, ask = code[asked > 0], asked[asked > 0]
        order = np.lexsort((ask, ask_code))
        ask_code, first = np.unique(ask_code[order], return_index=True)
        ask = ask[order][first]
        q = keys >> np.uint64(32)
        need = ask[np.searchsorted(ask_code, q.astype(np.uint32))] if len(q) else np.empty(0, np.uint8)
        to = ph.mix(q) % np.uint64(parts)
        held_in = [int(b) for b in np.unique(to)]
        data = [_pack_pairs(keys[s], n[s], need[s]) for s in (to == np.uint64(b) for b in held_in)]
        none = [pa.nulls(len(data), rows.schema.field(i).type) for i in range(2, 8)]
        return pa.Table.from_arrays([pa.array([int(names_of[b, 0]) for b in held_in], pa.int32()), pa.array(data, pa.binary()), *none], names=columns)

    packed = texts.select("key", "text", "asks").mapInArrow(build, kinds).repartition(parts, "bucket")
    seen = materialise(packed.groupBy("bucket").applyInArrow(meet, kinds), "fingerprints")

    def decide(key_: tuple, rows: pa.Table) -> pa.Table:
        keys, n, asked = (np.concatenate(x) for x in zip(*[_unpack_pairs(d.as_py()) for d in rows.column("data")]))
        order = np.argsort(keys, kind="stable")
        keys, n, asked = keys[order], n[order], asked[order]
        at = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        ok = np.add.reduceat(n, at) >= np.minimum.reduceat(asked, at)
        keys = keys[at][ok]
        return pa.table({"code_a": (keys >> np.uint64(32)).view(np.int64), "code_b": (keys & _LOW).view(np.int64)})

    met = seen.where("data is not null").select("bucket", "data").repartition(parts, "bucket").groupBy("bucket").applyInArrow(decide, "code_a bigint, code_b bigint")
    return seen.where("data is null").select("key", "asks", "c1", "c2", "code", "wide"), met, seen


def chain(seeds_a: np.ndarray, seeds_b: np.ndarray) -> np.ndarray:
    """Indices of the longest collinear run of seeds: both places rise."""
    order = np.lexsort((-seeds_b, seeds_a))
    tails: list[int] = []
    last: list[int] = []
    back = np.full(len(order), -1)
    for i in order:
        k = bisect_left(tails, int(seeds_b[i]))
        back[i] = last[k - 1] if k else -1
        tails[k : k + 1], last[k : k + 1] = [int(seeds_b[i])], [int(i)]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return np.array(out[::-1], np.int64)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """(seeds in the chain, which of ``a``'s places the extended chain covers); a and b are phrases in order of place."""
    zero = np.zeros(max(len(a), len(b)), np.int64)
    fa, fb = fingerprints(a, zero[: len(a)]), fingerprints(b, zero[: len(b)])
    covered = np.zeros(len(a), bool)
    where = {int(x): int(i) for i, x in zip(fb[::-1], b[fb][::-1])}  # the first place of each
    pairs = [(int(i), where[int(x)]) for i, x in zip(fa, a[fa]) if int(x) in where]
    if not pairs:
        return 0, covered
    sa, sb = (np.array(x) for x in zip(*pairs))
    kept = chain(sa, sb)
    for i, j in zip(sa[kept], sb[kept]):
        if covered[i]:
            continue
        m = min(len(a) - i, len(b) - j)
        same = a[i : i + m] == b[j : j + m]
        right = m if same.all() else int(same.argmin())
        m = min(i, j)
        same = a[i - m : i][::-1] == b[j - m : j][::-1]
        left = m if same.all() else int(same.argmin())
        covered[i - left : i + right] = True
    return len(kept), covered


def contains(a: np.ndarray, b: np.ndarray, contained: float) -> tuple[int, int, int, float] | None:
    """(phrases of a, those known to be in b, seeds, share of a's places in the chain) if b holds enough of a; sets decide where the chain falls short."""
    seeds, covered = align(a, b)
    mine = np.unique(a)
    need = contained * len(mine) - 1e-9
    common = len(np.unique(a[covered]))
    if common < need:
        common = int(np.isin(mine, np.unique(b), assume_unique=True).sum())
    return (len(mine), common, seeds, float(covered.mean())) if common >= need else None


def overlaps(texts: DataFrame, contained: float = CONTAINED) -> tuple[DataFrame, DataFrame]:
    """(overlaps: rep_a, rep_b, n_a, common, seeds, coverage; members: key, asks, rep).

    ``texts``: key, text, asks (true: evaluation, false: training; null rows are left out). Texts under 30 words
    and null or blank ones have no phrases; a key delivered twice is one record; null keys are left out; records
    of one side with equal sets of phrases are one class, named by its smallest key; empty tables give empty
    tables. ``common`` counts the phrases known to be shared when the pair was accepted.
    """
    rows = texts.where("key is not null and asks is not null").select("key", "text", "asks")
    docs, met, seen = candidates(rows, contained)
    met = materialise(met, "met")
    again = None
    wide = docs.where("wide").select("key").distinct()
    if wide.limit(1).count():  # texts that repeat themselves, by all their phrases
        _, more, again = candidates(rows.join(wide, "key", "left_semi").where("asks").unionByName(rows.where("not asks")), contained, 1)
        met = met.unionByName(more).distinct()
    classes = materialise(docs.groupBy("asks", "c1", "c2", "code").agg(F.min("key").alias("rep")), "classes")
    side = lambda asks, s: classes.where(F.col("asks") == asks).select(F.col("code").alias(f"code_{s}"), F.col("rep").alias(f"rep_{s}"))
    todo = materialise(met.join(side(True, "a"), "code_a").join(side(False, "b"), "code_b").select("rep_a", "rep_b"), "candidates")
    reps = small(todo.select(F.col("rep_a").alias("key")).union(todo.select("rep_b")).distinct())
    kind = texts.schema["key"].dataType.simpleString()

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = b.column(1).to_pylist()
            for lo, hi in ph.chunks(all_texts):
                g, doc, _ = ph.phrases(all_texts[lo:hi])
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([g[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["rep", "data"])

    sets = materialise(rows.join(reps, "key", "left_semi").select("key", "text").mapInArrow(ordered, f"rep {kind}, data binary").groupBy("rep").agg(F.first("data").alias("data")), "sets")
    both = todo.join(sets.select(F.col("rep").alias("rep_a"), F.col("data").alias("a")), "rep_a").join(sets.select(F.col("rep").alias("rep_b"), F.col("data").alias("b")), "rep_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [contains(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), contained) for x, y in zip(batch.column("a"), batch.column("b"))]
            keep = [i for i, x in enumerate(got) if x]
            cols = list(zip(*[got[i] for i in keep])) if keep else [[]] * 4
            ids = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("rep_a", "rep_b")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64())))], ["rep_a", "rep_b", "n_a", "common", "seeds", "coverage"])

    found = both.select("rep_a", "rep_b", "a", "b").mapInArrow(compare, f"rep_a {kind}, rep_b {kind}, n_a bigint, common bigint, seeds bigint, coverage double")
    found = materialise(found, "overlaps")
    rep = classes.groupBy("asks", "c1", "c2").agg(F.min("rep").alias("rep"))
    members = materialise(docs.join(rep, ["asks", "c1", "c2"]).select("key", "asks", "rep").distinct(), "members")
    for done in (seen, met, again, classes, todo, sets):
        if done is not None:
            release(done)
    return found, members


def corpus_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, text, asks, split, nation of the provisions whose document has a split; case and spaces of the split's name aside."""
    name = F.lower(F.trim("split_name"))
    plan = table(spark, sf_dir, "split_plan").select("doc_id", name.alias("split")).where(name.isin("train", "validation", "test")).distinct()
    corpus = table(spark, sf_dir, "corpus").select("provision_id", "doc_id", "nation", "text")
    return corpus.join(small(plan), "doc_id").select(F.col("provision_id").alias("key"), "text", (F.col("split") != "train").alias("asks"), "split", plain(F.col("nation")).alias("nation"))


def _members(members: DataFrame, asks: bool) -> DataFrame:
    return members.where(F.col("asks") == asks).select("key", "rep")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of an evaluation provision and a training provision that holds at least 80 % of its phrases."""
    found, members = overlaps(corpus_by_split(spark, sf_dir))
    both = expand(expand(found.select("rep_a", "rep_b"), _members(members, True), "rep_a", "key_a"), _members(members, False), "rep_b", "key_b")
    return both.select(F.least("key_a", "key_b").alias("provision_id_a"), F.greatest("key_a", "key_b").alias("provision_id_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and nation: evaluation provisions, those that recur in training, pairs, and how much of them the alignment covers."""
    source = corpus_by_split(spark, sf_dir)
    found, members = overlaps(source)
    per_rep = found.join(_members(members, False).groupBy(F.col("rep").alias("rep_b")).agg(F.count("*").alias("copies")), "rep_b").groupBy("rep_a").agg(F.sum("copies").alias("n_pairs"), F.max("coverage").alias("coverage"))
    per_key = _members(members, True).withColumnRenamed("rep", "rep_a").join(per_rep, "rep_a").select("key", "n_pairs", "coverage")
    asked = source.where("asks").select("key", "split", "nation").distinct()
    return asked.join(per_key, "key", "left").groupBy("split", "nation").agg(
        F.count("*").alias("n_provisions"), F.count("n_pairs").alias("n_overlapping"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), F.avg("coverage").alias("mean_coverage"))


SQL = {
    "p2_found": """
WITH s AS (SELECT DISTINCT doc_id, lower(trim(split_name)) = 'train' AS tr FROM split_plan WHERE lower(trim(split_name)) IN ('train', 'validation', 'test')),
one AS (SELECT provision_id, tr, regexp_extract_all(lower(min(text)), '[a-z0-9]+') w FROM corpus JOIN s USING (doc_id) WHERE provision_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT provision_id, tr, unnest(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) g FROM one WHERE len(w) >= 30),
n AS (SELECT provision_id, count(*) n FROM p WHERE NOT tr GROUP BY 1),
c AS (SELECT x.provision_id a, y.provision_id b, count(*) c FROM p x JOIN p y ON x.g = y.g AND NOT x.tr AND y.tr GROUP BY 1, 2)
SELECT DISTINCT least(a, b) AS provision_id_a, greatest(a, b) AS provision_id_b FROM c JOIN n ON n.provision_id = a WHERE c >= 0.8 * n
""",
}
