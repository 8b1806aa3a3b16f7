"""Problem 8: encode every text with a public byte-level BPE vocabulary.

The vocabulary file (one base64 piece and its rank per line) is serialised by hand as a sentencepiece BPE
model: every byte of a piece is mapped to one printable character, the score is the negative rank, the
normaliser is the identity. Texts are cut into pre-tokens, each pre-token is mapped and encoded alone, and
decoding inverts the mapping. The model is about 1 MB whatever the corpus, so it is broadcast.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The pre-token pattern of the public vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A run of white space with the word that follows it. No pre-token crosses such a chunk, so chunks can be remembered.
CHUNK = r"\s*\S+|\s+"

#: Chunks a worker remembers before it starts anew; it only saves time.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """One printable character for every byte: itself where it is printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    by_rank = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("the ranks of the vocabulary have a gap")
    return [by_rank[i] for i in range(len(by_rank))]


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece model of kind BPE whose ids are the ranks; the unknown piece, never used, comes last."""
    mapped = byte_characters()
    absent = (1 << 64) - 1  # -1: no such special piece
    body = b"".join(_piece("".join(mapped[b] for b in p), -float(rank), 1) for rank, p in enumerate(pieces))
    body += _piece("<unk>", 0.0, 2)
    trainer = b"".join(_field(k, v) for k, v in ((3, 2), (4, len(pieces) + 1), (40, len(pieces)), (41, absent), (42, absent), (43, absent)))
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes with one serialised model; remembers the ids of chunks it has seen."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._table = {b: c for b, c in enumerate(byte_characters())}
        self._back = {c: b for b, c in self._table.items()}
        self._pre = regex.compile(PRE_TOKEN).findall
        self._chunks = regex.compile(CHUNK).findall
        self._known: dict[str, list[int]] = {}

    def _new(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for token in self._pre(chunk):
            raw = token.encode("utf-8", "surrogatepass").decode("latin-1")
            ids += self._model.encode(raw.translate(self._table))
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        self._known[chunk] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known = self._known
        return list(itertools.chain.from_iterable([known.get(c) or self._new(c) for c in self._chunks(text)]))

    def decode(self, ids: list[int]) -> str:
        mapped = "".join(self._model.id_to_piece(int(i)) for i in ids)
        return bytes(self._back[c] for c in mapped).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lengths_only: bool = False) -> DataFrame:
    """One row per input row: ``key`` and ``ids`` (or ``n_tokens`` with ``lengths_only``), without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they are; names of special tokens are
    ordinary text; repeated rows stay repeated; other columns are dropped, so none can clash; an empty table
    gives an empty table. There is no shuffle.
    """
    model = df.sparkSession.sparkContext.broadcast(serialise(read_vocabulary(vocabulary)))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if lengths_only:
                    made = pa.array(sizes)
                else:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1]))
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), made], [key, "n_tokens" if lengths_only else "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if lengths_only else "ids array<int>"))


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and the ``text`` that ``ids`` stand for; an empty list gives an empty text, null gives null."""
    model = df.sparkSession.sparkContext.broadcast(serialise(read_vocabulary(vocabulary)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of byte_bpe_50k."""
    from tesselith.sources.tables import table

    return encode(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, those whose text comes back from its ids, tokens, and bytes per token."""
    from tesselith.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    ids = encode(docs)
    back = decode(ids).withColumnRenamed("text", "back")
    sized = ids.select("doc_id", F.size("ids").cast("bigint").alias("n"))
    return (
        docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").join(sized, "doc_id")
        .groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(F.col("text") == F.col("back")).alias("n_same"),
                             F.sum("n").alias("n_tokens"), F.sum(F.octet_length("text")).alias("n_bytes"))
    )
