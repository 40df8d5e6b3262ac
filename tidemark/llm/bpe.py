"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Each vocabulary entry becomes a piece whose characters stand for its bytes and whose score is its
negative rank; the normaliser is the identity. Merging the best-scored adjacent pair is then the
same as merging the lowest rank. Texts are split by the tokenizer's pattern, each pre-token is
encoded on its own, and ids are decoded by the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_buffers

CHARS = "".join(map(chr, range(0x100, 0x200)))
MOST_CACHED = 250_000
#: longer pieces of text are encoded each time they come, so the cache is bounded in bytes too
LONGEST_CACHED = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) + body if kind == 2 else body)


def as_chars(piece: bytes) -> str:
    """One character for each byte: no white space, no control and no meta symbol among them."""
    return codecs.charmap_decode(piece, "strict", CHARS)[0]


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The ModelProto: piece i is the entry of rank i, then one unknown piece."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in order] != list(range(len(order))):
        raise ValueError("ranks must be 0 to n - 1")
    out = bytearray()
    for rank, piece in enumerate(order):
        body = _field(1, 2, as_chars(piece).encode()) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(1))
        out += _field(1, 2, body)
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(order) + 1)) + _field(40, 0, _varint(len(order)))
    trainer += b"".join(_field(n, 0, _varint((1 << 64) - 1)) for n in (41, 42, 43))  # no bos, eos, pad
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normaliser))


class Codec:
    """Encoding with a bounded memory of words, and decoding.

    A single space between two other characters that are no white space always begins a pre-token,
    so a text without neighbouring white space is cut there first; only words not met lately are
    split by the pattern and merged. Other texts are split by the pattern as a whole. Two
    generations of words are kept, of MOST_CACHED each and none longer than LONGEST_CACHED; the
    older one goes when the newer is full.
    """

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.has_run = re.compile(r"\s\s").search
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        #: of a piece of text: its ids as decimal text, their number, and their bytes as decoded
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def merged(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token; a whole entry is one id, whether merges reach it or not."""
        raws = [t.encode() for t in pre_tokens]
        todo = [i for i, raw in enumerate(raws) if raw not in self.ranks]
        done = dict(zip(todo, self.processor.encode([as_chars(raws[i]) for i in todo], num_threads=1), strict=True)) if todo else {}
        return [done[i] if i in done else [self.ranks[raw]] for i, raw in enumerate(raws)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def _learn(self, parts: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """Keeps what is met first, but for the long ones, which are returned."""
        fresh, long = [], {}
        for part in parts:
            if part in self.older:
                self.known[part] = self.older[part]
            else:
                fresh.append(part)
        tokens = [self.split(part) for part in fresh]
        ids = iter(self.merged([t for own in tokens for t in own]))
        for part, own in zip(fresh, tokens, strict=True):
            found = [i for _ in own for i in next(ids)]
            (self.known if len(part) <= LONGEST_CACHED else long)[part] = ",".join(map(str, found)), len(found), self.decode(found)
        return long

    def parts(self, text: str) -> list[str]:
        """Pieces of the text that split into pre-tokens as the whole does."""
        if self.has_run(text):
            return self.split(text)
        first, *words = text.split(" ")
        return [first] * bool(first) + [" " + w for w in words]

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[str], list[int], list[bytes]]]:
        """For each text the decimal ids, numbers of ids and decoded bytes of its parts."""
        cut = [self.parts(t) for t in texts]
        missing, long = set().union(*cut).difference(self.known) if cut else set(), {}
        if missing:
            if len(self.known) > MOST_CACHED:
                self.older, self.known = self.known, {}
                missing = set().union(*cut)
            long = self._learn(missing)
        for own in cut:
            got = [self.known[p] if p in self.known else long[p] for p in own]
            yield [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]

    def encode(self, text: str) -> list[int]:
        return [int(i) for own, _, _ in self.encode_all([text]) for part in own for i in part.split(",")]


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs(doc_id, text).

    ids_sha256 digests the decimal ids joined by commas, decoded_sha256 the decoded bytes; with_ids
    adds the ids. Null texts are empty: no ids. The rank file has a fixed size and is broadcast as
    read, with the model made from it. Extra columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((serialised_model(ranks), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value, pattern)
        for batch in batches:
            # a slice at a time: ids take many times the room of their text
            for i, j in slices(text_buffers(batch.column(1))[1]):
                counts, digests, decoded, lists = [], [], [], []
                for ids, numbers, raw in codec.encode_all([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]):
                    joined = ",".join(ids)
                    counts.append(sum(numbers))
                    digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(raw)).hexdigest())
                    if with_ids:
                        lists.append(np.array(joined.split(",") if joined else [], dtype=np.int32))
                columns = [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists))))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, fields)

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


def decoded_texts(spark: SparkSession, rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and text of rows(doc_id, ids); bytes that are no UTF-8 become the replacement character."""
    shared = spark.sparkContext.broadcast({rank: piece for piece, rank in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(shared.value[i] for i in ids.as_py() or []).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
