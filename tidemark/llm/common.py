"""Shared pieces of the training-data operators: working folders, token arrays and hashes.

Words are the runs `[^\\x20\\x09-\\x0D]+` of a text throughout. The numpy kernels work on the
bytes of an Arrow string column in slices of whole documents, so that memory follows the slice
and not the partition.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors may lack this package: send its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

WHITE = " \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 21


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; a temporary one only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, value: object) -> Callable[[], Any]:
    """Broadcast a value that may hold this package's classes; the result loads it within a task.

    A plain broadcast names classes by their module, which executors may lack.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    loaded: list[Any] = []

    def load() -> Any:
        if not loaded:
            loaded.append(cloudpickle.loads(shared.value))
        return loaded[0]

    return load


def words_column(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    bare = F.trim(F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " +"))


# --- numpy kernels --------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


class Hasher:
    """Polynomial word hashes over a byte buffer, by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.values = _byte_values()
        self.base = _ODD | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            steps = np.full(n, self.base, dtype=np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = np.uint64(self.inverse)
            self.inverses = np.cumprod(steps, dtype=np.uint64)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end] (end exclusive)."""
        n = len(data)
        self.grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], dtype=np.uint64, out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """Lower-cased (A-Z) words of a slice of documents: spans, hashes and their documents.

    Words are runs of bytes that `full` marks, of bytes that are not white space where it is not given.
    """

    def __init__(self, hasher: Hasher, raw: np.ndarray, offsets: np.ndarray, lower: bool = True, full: np.ndarray | None = None) -> None:
        self.data = data = _LOWER[raw] if lower else raw
        n_docs = len(offsets) - 1
        full = ~_IS_WHITE[data] if full is None else full
        first = np.empty(len(data), dtype=bool)
        last = np.empty(len(data), dtype=bool)
        if len(data):
            first[0], first[1:] = True, ~full[:-1]
            last[-1], last[:-1] = True, ~full[1:]
            begins = offsets[:-1]
            first[begins[begins < len(data)]] = True
            ends = offsets[1:] - 1
            last[ends[ends >= 0]] = True
        self.start = np.flatnonzero(full & first)
        self.end = np.flatnonzero(full & last) + 1
        self.hash = hasher.spans(data, self.start, self.end)
        #: bounds[d]:bounds[d + 1] are the words of document d
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n_docs), np.diff(self.bounds))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a short text is one shingle."""
    h, bounds = words.hash, words.bounds
    rolled = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(_ODD) + h[k : k + len(rolled)]
    rolled = mix(rolled)
    for d in range(len(bounds) - 1):
        a, b = bounds[d], bounds[d + 1]
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            one = np.zeros(1, dtype=np.uint64)
            for x in h[a:b]:
                one = one * np.uint64(_ODD) + x
            yield mix(one + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
