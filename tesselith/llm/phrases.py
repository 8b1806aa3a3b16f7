"""Phrases (runs of five words) of whole texts as 48-bit numbers, and how common they are.

The words of a text are the maximal runs of a-z and 0-9 after lower-casing. A batch of texts is hashed at once:
polynomial prefix sums give every word a number, five successive numbers give a phrase. A counting sketch, with about
a cell for two phrases up to a bound, says roughly how many texts hold a phrase; it only orders phrases and splits
hot ones, so its errors cost time and never a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.plans.lineage import tidied

WORDS = 5
MIN_WORDS = 30

#: Least and most cells of the sketch (one byte each once it is merged: 64 MB at most), and rows in which they travel.
LEAST_CELLS, MOST_CELLS, SKETCH_SLICES = 1 << 20, 1 << 26, 64

#: Texts that may share a phrase before its bucket is split.
HOT = 4096

#: Characters and texts hashed at once; the number of a text in its chunk and a phrase fit in 64 bits.
CHUNK_CHARS, CHUNK_TEXTS = 1 << 20, 60_000
_BITS = np.uint64(48)
_MASK = np.uint64((1 << 48) - 1)

_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = max(_POWERS, default=0)
    if have < n:
        size = max(n, CHUNK_CHARS * 2)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        up, down = np.full(size, _P, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = (np.cumprod(up), np.cumprod(down))
    return next(iter(_POWERS.values()))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of every word, index of its text), in order."""
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower()
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = _IS_WORD[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    up, down = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(np.nonzero(raw == 0)[0], start, side="right")


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_CHARS characters; a longer text stands alone and whole."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if (size and size + n > CHUNK_CHARS) or i - at >= CHUNK_TEXTS:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def _runs(w: np.ndarray, n: int) -> np.ndarray:
    """A number for every run of ``n`` successive words."""
    k = np.uint64(0xD6E8FEB86659FD93)
    m = len(w) - n + 1
    g = w[:m].copy()
    for i in range(1, n):
        g = g * k + w[i : m + i]
    return g


def phrases(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases in order of place, index of their text, words of each text); texts under MIN_WORDS words have none."""
    return phrases_and_turns(texts, False)[:3]


def phrases_and_turns(texts: list[str | None], turns: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``phrases``, and for each whether its first or last four words stand elsewhere in its text too, so that the text can go on in two ways there."""
    w, doc = word_hashes(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    if len(w) < WORDS:
        return np.empty(0, np.uint64), np.empty(0, np.int64), n_words, np.empty(0, bool)
    first = doc[: len(w) - WORDS + 1]
    ok = (first == doc[WORDS - 1 :]) & (n_words[first] >= MIN_WORDS)
    g = mix(_runs(w, WORDS)[ok]) >> np.uint64(16)
    if not turns:
        return g, first[ok], n_words, np.empty(0, bool)
    own = doc[: len(w) - WORDS + 2]
    four = (own.astype(np.uint64) << _BITS) | (mix(_runs(w, WORDS - 1)) >> np.uint64(16))
    four[own != doc[WORDS - 2 :]] = np.uint64(0xFFFFFFFFFFFFFFFF)  # runs over two texts
    run = np.sort(four)
    twice = np.isin(four, np.unique(run[1:][run[1:] == run[:-1]]))
    return g, first[ok], n_words, (twice[:-1] | twice[1:])[ok]


def distinct(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases without repeats within a text, sorted by text and number."""
    both = np.sort((doc.astype(np.uint64) << _BITS) | g)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both & _MASK, (both >> _BITS).astype(np.int64)


def firsts(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the first occurrence of every phrase in its text, in order."""
    both = (doc.astype(np.uint64) << _BITS) | g
    order = np.argsort(both, kind="stable")
    run = both[order]
    return np.sort(order[np.concatenate([[True], run[1:] != run[:-1]])]) if len(both) else order


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sum of ``values`` (any unsigned kind) by text."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values.astype(np.uint64))])
    at = np.searchsorted(doc, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def identity(g: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits (as two numbers) that tell sets of phrases apart, and the size of each set. ``g`` comes from ``distinct``."""
    size = np.bincount(doc, minlength=n)
    one, two = per_text(mix(g + np.uint64(1)), doc, n), per_text(mix(g ^ np.uint64(0xA24BAED4963EE407)), doc, n)
    return mix(one + size.astype(np.uint64)), mix(two ^ one), size


def levels(cells: np.ndarray) -> np.ndarray:
    """Counts as one byte: 0 for at most one text, else steps of the logarithm."""
    return np.where(cells <= 1, 0, np.minimum(255, 10 * np.log2(np.maximum(cells, 2)))).astype(np.uint8)


def survey(texts: DataFrame, text: str = "text", cells: int | None = None) -> tuple[Broadcast, int]:
    """Two scans of all texts: (the sketch of phrase counts as a broadcast, number of phrases).

    The sketch has a cell for about two phrases, but at most MOST_CELLS: beyond, cells are shared and only common phrases stand
    out. The number sizes the later exchanges.
    """
    spark = texts.sparkSession
    if cells is None:
        with tidied(spark):
            chars = texts.agg(F.sum(F.length(text))).first()[0] or 0
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (chars // 12).bit_length()))
    width = cells // SKETCH_SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint16)
        found = 0
        for b in batches:
            part = b.column(0).to_pylist()
            for lo, hi in chunks(part):
                g, doc, _ = phrases(part[lo:hi])
                g, doc = distinct(g, doc)
                found += len(g)
                cell, n = np.unique((g & np.uint64(cells - 1)).astype(np.int64), return_counts=True)
                counts[cell] = np.minimum(counts[cell].astype(np.int64) + n, 65535)
        slices = [s for s in range(SKETCH_SLICES) if counts[s * width : (s + 1) * width].any()]
        data = [zlib.compress(counts[s * width : (s + 1) * width].tobytes(), 1) for s in slices]
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(data, pa.binary()), pa.array([found] + [0] * (len(slices) - 1) if slices else [], pa.int64())], ["slice", "data", "n"])

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for data in parts.column("data"):
            total += np.frombuffer(zlib.decompress(data.as_py()), np.uint16)
        n = sum(parts.column("n").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zlib.compress(levels(total).tobytes(), 1)], pa.binary()), "n": pa.array([n], pa.int64())})

    kinds = "slice int, data binary, n bigint"
    merged = texts.select(F.col(text)).mapInArrow(run, kinds).groupBy("slice").applyInArrow(merge, kinds)
    sketch, n = np.zeros(cells, np.uint8), 0
    with tidied(spark):
        slices = merged.collect()
    for r in slices:  # at most SKETCH_SLICES rows, one byte a cell
        sketch[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
        n += r["n"]
    return spark.sparkContext.broadcast(sketch.tobytes()), n


def exchange_parts(spark: SparkSession, n: int, each: int) -> int:
    """Buckets of a packed exchange of ``n`` entries: at least the shuffle partitions, at most ``each`` entries in one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // each))


def even_names(spark: SparkSession, parts: int) -> np.ndarray:
    """(parts, 2): two names for every bucket such that an exchange by name over ``parts`` partitions puts both, and no others, into one."""
    each = 20
    while True:
        many = spark.range(parts * each).select(F.col("id").cast("int").alias("name"))
        held = many.groupBy(F.pmod(F.hash("name"), F.lit(parts)).alias("part")).agg(F.slice(F.sort_array(F.collect_list("name")), 1, 2).alias("names"))
        with tidied(spark):
            names = {r.part: r.names for r in held.collect() if len(r.names) == 2}  # a row for each bucket
        if len(names) == parts:
            return np.array([names[i] for i in range(parts)], np.int64)
        each *= 2


def hot_parts(level: np.ndarray, hot: int) -> np.ndarray:
    """Into how many parts a phrase's bucket is split, by the level of the phrase: one for each ``hot`` texts, as a power of two."""
    return np.exp2(np.maximum(0, np.ceil(level / 10 - np.log2(hot)))).astype(np.int64)


def bucket_of(g: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a phrase and one of its parts."""
    return ((mix(g + part.astype(np.uint64) * _P) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def commonness(sketch: Broadcast, g: np.ndarray) -> np.ndarray:
    """The level of every phrase: 0 only if no other text holds it."""
    cells = np.frombuffer(sketch.value, np.uint8)
    return cells[(g & np.uint64(len(cells) - 1)).astype(np.int64)]

