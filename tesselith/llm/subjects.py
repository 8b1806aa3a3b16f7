"""Problem 10: the subjects that each document deals with.

A sentence is the average of its words' vectors; the vector of a word is its own embedding plus the average of
its character n-grams' embeddings; independent logistic outputs tell the subjects. Embeddings and outputs are
trained together on the sentences of labelled documents: in every round each partition computes the gradient of
its sentences, the gradients are summed, and one step of Adam follows. A document deals with a subject if the
sentences assigned to it make up a given share of its words, so passing mentions do not count.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.llm.phrases import _powers, chunks, mix
from tesselith.plans.lineage import materialise
from tesselith.plans.sizing import small
from tesselith.sources.tables import table

#: Labelled documents that the model is fitted on at most, drawn by a hash; every document is scored.
MOST_LABELLED = 6_000

DIM, BUCKETS, GRAMS = 24, 1 << 16, (3, 4)
ROUNDS, RATE = 30, 0.1

#: Partitions over which gradients are summed, and least probability and share of words of a subject.
PARTS, SURE, SHARE = 6, 0.5, 0.16

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), 0xC3]] = True


def cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(start and end of every word in the bytes, sentence of every word, text of every sentence, bytes)."""
    raw_bytes = "\0".join((t or "").replace("\0", " ") for t in texts).lower().encode("utf-8", "surrogatepass")
    raw = np.frombuffer(raw_bytes, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), raw_bytes
    inside = _INSIDE[raw]
    inside[1:] |= raw[:-1] == 0xC3  # the second byte of an accented letter
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    after = np.append(raw[1:], 32)
    stop = (raw == 0) | (raw == 10) | (np.isin(raw, (46, 33, 63)) & np.isin(after, (32, 10, 0)))
    stops = np.nonzero(stop)[0]
    sentence = np.searchsorted(stops, start)
    doc_of_stop = np.searchsorted(np.nonzero(raw == 0)[0], np.append(stops, len(raw)), side="left")
    return start, end, sentence, doc_of_stop, raw_bytes


def word_numbers(start: np.ndarray, end: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(index of every word among the distinct ones, place of each distinct word); 64-bit hashes of whole words tell them apart."""
    b = np.frombuffer(raw, np.uint8)
    up, down = _powers(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return which, first


def features(word: bytes) -> np.ndarray:
    """The bucket of the word, then those of its character n-grams, however long it is."""
    text = b"<" + word + b">"
    parts = [text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1)]
    return np.array([zlib.crc32(text, 1), *map(zlib.crc32, parts)], np.int64) % BUCKETS


def word_matrix(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, weight) of the sum that makes word vectors: the word's own bucket and the mean of its n-grams."""
    size = np.array([len(x) for x in lists])
    word = np.repeat(np.arange(len(lists)), size)
    bucket = np.concatenate(lists) if lists else np.empty(0, np.int64)
    own = np.zeros(len(word), bool)
    own[np.cumsum(size) - size] = True
    weight = np.where(own, 1.0, 1.0 / np.maximum(1, size - 1)[word]).astype(np.float32)
    return word, bucket, weight


def _sum_rows(values: np.ndarray, sorted_index: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(sorted_index):
        at = np.nonzero(np.concatenate([[True], sorted_index[1:] != sorted_index[:-1]]))[0]
        out[sorted_index[at]] = np.add.reduceat(values, at, axis=0)
    return out


class Block:
    """Sentences of labelled documents, ready for gradients."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        start, end, sentence, doc, raw = cut(texts)
        which, first = word_numbers(start, end, raw)
        used, sentence = np.unique(sentence, return_inverse=True)
        self.y = labels[doc[used]]
        self.word, self.sentence = which.astype(np.int32), sentence.astype(np.int32)
        self.size = np.bincount(sentence, minlength=len(used)).astype(np.float32)
        keep = self.size >= 4
        self.weight = np.where(keep, 1.0, 0.0).astype(np.float32)
        w, b, c = word_matrix([features(raw[start[f] : end[f]]) for f in first])
        self.n_words = len(first)
        self.buckets, local = np.unique(b, return_inverse=True)
        local = local.astype(np.int32)
        self.fw, self.fb, self.fc = w, local, c[:, None]
        self.by_bucket = np.argsort(local, kind="stable").astype(np.int32)
        self.by_word = np.argsort(which, kind="stable").astype(np.int32)

    def gradient(self, rows: np.ndarray, w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Gradients for ``rows`` (the embeddings of ``self.buckets``), the outputs and their bias; the loss and the weight."""
        vec = _sum_rows(rows[self.fb] * self.fc, self.fw, self.n_words)
        sent = _sum_rows(vec[self.word], self.sentence, len(self.size)) / self.size[:, None]
        z = sent @ w + bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        d = (p - self.y) * self.weight[:, None]
        loss = float(-(self.weight[:, None] * (self.y * np.log(p + 1e-9) + (1 - self.y) * np.log(1 - p + 1e-9))).sum())
        g_sent = (d @ w.T) / self.size[:, None]
        g_vec = _sum_rows(g_sent[self.sentence[self.by_word]], self.word[self.by_word], self.n_words)
        g_rows = _sum_rows((g_vec[self.fw] * self.fc)[self.by_bucket], self.fb[self.by_bucket], len(self.buckets))
        return g_rows, sent.T @ d, d.sum(0), loss, float(self.weight.sum())


class Adam:
    """Steps of Adam for a list of arrays."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray], scale: float) -> None:
        self.t += 1
        for a, m, v, g in zip(self.arrays, self.m, self.v, grads):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            a -= scale * self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.98**self.t)) + 1e-8)


def start_values(rows: int, n_subjects: int, seed: int = 17) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (rows, DIM)).astype(np.float32)
    return [e, rng.normal(0, 0.05, (DIM, n_subjects)).astype(np.float32), np.full(n_subjects, -2.5, np.float32)]


class Scorer:
    """Shares of a document's words by subject, from the trained arrays."""

    def __init__(self, buckets: np.ndarray, e: np.ndarray, w: np.ndarray, bias: np.ndarray):
        self.outputs, self.bias = np.zeros((BUCKETS, w.shape[1]), np.float32), bias
        self.outputs[buckets] = e @ w  # n-grams that no labelled sentence has say nothing
        self.known: dict[bytes, np.ndarray] = {}

    def word(self, raw: bytes) -> np.ndarray:
        got = self.known.get(raw)
        if got is None:
            f = features(raw)
            got = self.outputs[f[0]] + (self.outputs[f[1:]].mean(0) if len(f) > 1 else 0)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[raw] = got
        return got

    def shares(self, texts: list[str | None], sure: float = SURE) -> np.ndarray:
        """(texts, subjects): share of the words that stand in sentences assigned to the subject; a sentence may have several subjects."""
        n_subjects = self.outputs.shape[1]
        out = np.zeros((len(texts), n_subjects))
        start, end, sentence, doc, raw = cut(texts)
        if not len(start):
            return out
        which, first = word_numbers(start, end, raw)
        logits = np.stack([self.word(raw[start[f] : end[f]]) for f in first]).astype(np.float32)
        at = np.nonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))[0]
        size = np.diff(np.append(at, len(sentence)))
        z = np.add.reduceat(logits[which], at, axis=0) / size[:, None] + self.bias
        owner = doc[sentence[at]]
        i, j = np.nonzero(z > np.log(sure / (1 - sure)))
        np.add.at(out, (owner[i], j), size[i])
        total = np.bincount(owner, size, minlength=len(texts))
        return out / np.maximum(total, 1)[:, None]


_BLOCKS: dict[tuple[str, int], Block] = {}


def _block(name: str, part: int, data: bytes) -> Block:
    """The block, kept in the worker between rounds."""
    if (name, part) not in _BLOCKS:
        if len(_BLOCKS) >= 2 * PARTS:
            _BLOCKS.clear()
        _BLOCKS[name, part] = pickle.loads(data)
    return _BLOCKS[name, part]


def labelled(docs: DataFrame, labels: DataFrame, names: list[str], most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents, by hash order; case, spaces and repeats of labels aside."""
    name = F.lower(F.trim("subject"))
    per_doc = labels.where(F.col("doc_id").isNotNull() & name.isin(names)).groupBy("doc_id").agg(F.collect_set(F.array_position(F.lit(names), name).cast("int") - 1).alias("y"))
    per_doc = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.where("text is not null and trim(text) <> ''").select("doc_id", "text").join(small(per_doc, most), "doc_id")


def train(sample: DataFrame, n_subjects: int, rounds: int = ROUNDS, rate: float = RATE) -> list[np.ndarray]:
    """[buckets, their embeddings, outputs, bias], fitted on ``sample`` (text, y)."""
    spark = sample.sparkSession

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        y = np.zeros((rows.num_rows, n_subjects), np.float32)
        for i, s in enumerate(rows.column("y").to_pylist()):
            y[i, s] = 1
        block = Block(rows.column("text").to_pylist(), y)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(block, 5)], pa.binary()), "buckets": pa.array([block.buckets.astype(np.int32).tobytes()], pa.binary())})

    parts = sample.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    blocks = materialise(parts.groupBy("part").applyInArrow(build, "part int, data binary, buckets binary"), "blocks")
    name = blocks._tesselith_path
    lists = [np.frombuffer(r["buckets"], np.int32) for r in blocks.select("buckets").collect()]  # at most BUCKETS numbers a part
    if not lists:
        return [np.empty(0, np.int64), np.empty((0, DIM), np.float32), np.zeros((DIM, n_subjects), np.float32), np.full(n_subjects, -30, np.float32)]
    buckets = np.unique(np.concatenate(lists))
    values = start_values(len(buckets), n_subjects)
    adam = Adam(values, rate)
    held = blocks.select("part", "data").repartition(PARTS, "part").persist()
    for r in range(rounds):
        now = spark.sparkContext.broadcast((buckets, *values))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            b, e, w, bias = now.value
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    block = _block(name, part, data.as_py())
                    at = np.searchsorted(b, block.buckets)
                    g, gw, gb, _, weight = block.gradient(e[at], w, bias)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((at.astype(np.int32), g, gw, gb, weight), 5)], pa.binary())], ["g"])

        sums, weight = [np.zeros_like(v) for v in values], 0.0
        for row in held.mapInArrow(run, "g binary").collect():  # one gradient a part
            at, g, gw, gb, part_weight = pickle.loads(row["g"])
            sums[0][at] += g
            sums[1] += gw
            sums[2] += gb
            weight += part_weight
        adam.step([s / max(weight, 1.0) for s in sums], 1 - 0.9 * r / rounds)
        now.destroy()
    held.unpersist()
    return [buckets, *values]


def assign(docs: DataFrame, model: list[np.ndarray], names: list[str], share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share): one row for each subject that a row of ``docs`` deals with; null, empty and blank texts have none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                got = scorer.shares(texts[lo:hi])
                i, j = np.nonzero(got >= share)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + lo)), pa.array([names[k] for k in j], pa.string()), pa.array(got[i, j])], ["doc_id", "subject", "share"])

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, subject string, share double")


def deal_with(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """The subjects of every document of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, subject) of ``subjects`` (subject).

    Labels of no listed subject, of no document, or null are left out; without any label no document has a
    subject; repeated rows stay repeated; extra columns are ignored.
    """
    names = [r[0] for r in subjects.select(F.lower(F.trim("subject"))).distinct().orderBy(F.lower(F.trim("subject"))).collect() if r[0]]  # the list of subjects
    if not names:
        return docs.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("share")).limit(0)
    shown = {r[0]: r[1] for r in subjects.select(F.lower(F.trim("subject")), F.trim("subject")).collect()}
    model = train(labelled(docs, labels, names), len(names))
    return assign(docs, model, [shown[n] for n in names])


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of all documents."""
    return deal_with(*_tables(spark, sf_dir)).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and summed shares by subject."""
    got = deal_with(*_tables(spark, sf_dir))
    return got.groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("share").alias("sum_share"))


def p10_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall on a fifth of the labelled documents, the model fitted on the others."""
    docs, labels, subjects = _tables(spark, sf_dir)
    fifth = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 0
    test = labels.where(fifth).select("doc_id", F.lower(F.trim("subject")).alias("subject")).distinct()
    got = deal_with(docs.join(small(labels.select("doc_id").distinct()), "doc_id", "left_semi"), labels.where(~fifth), subjects)
    got = got.where(fifth).select("doc_id", "subject").distinct()
    both = test.withColumn("t", F.lit(1)).join(got.withColumn("g", F.lit(1)), ["doc_id", "subject"], "full")
    hit = F.count_if(F.col("t").isNotNull() & F.col("g").isNotNull())
    return both.agg(F.count("t").alias("n_labels"), F.count("g").alias("n_found"), hit.alias("n_right"), (hit / F.count("g")).alias("precision"), (hit / F.count("t")).alias("recall"))
