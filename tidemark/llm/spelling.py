"""Spelling variants by PartEnum signatures over letter multisets.

A word's letters are a binary vector: one dimension for the first, second, ... occurrence of each
letter. One inserted, deleted or replaced letter changes two dimensions at most. The dimensions are
dealt to PARTS parts by hash; two vectors that differ in two dimensions agree outside two parts, so
they share one of the signatures made of all parts but two. Words are joined on equal signatures
and verified by edit distance within the join, so a signature shared by many words is never written
out as pairs. A pair is emitted by the first signature it shares only.

Besides, one edit leaves the first or the last three of six letters as they are, so each signature
is made once with either; words whose letters are the same in another order fall apart by that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Words, mix, slices, text_buffers, written

PARTS = 4
DROPS = list(combinations(range(PARTS), 2))
SEED = 199
ENDS = 3


def letter_bytes(raw: np.ndarray) -> np.ndarray:
    """Marks the bytes of A-Z, a-z and U+00C0 to U+00FF; the latter are 0xC3 and the byte after it."""
    wide = raw == 0xC3
    low = raw | 0x20
    full = wide | ((low >= ord("a")) & (low <= ord("z")))
    full[1:] |= wide[:-1]
    return full


def counted_runs(batches: Iterator[pa.RecordBatch], least_length: int) -> Iterator[pa.RecordBatch]:
    """word, n of the letter runs of (id, text), summed over each slice of whole texts.

    Runs are lower-cased A-Z only; where crc32 of `id:run` is a multiple of SEED, the code point at
    that value modulo the run's length is deleted.
    """
    hasher = Hasher()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        raw, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets):
            part = raw[offsets[i] : offsets[j]]
            runs = Words(hasher, part, offsets[i : j + 1] - offsets[i], full=letter_bytes(part))
            _, at, which = np.unique(runs.hash, return_index=True, return_inverse=True)
            blob = runs.data.tobytes()
            words = [blob[a:b] for a, b in zip(runs.start[at].tolist(), runs.end[at].tolist())]
            starts = [crc32(b"%s:" % str("" if x is None else x).encode()) for x in ids[i:j]]
            hashes = np.fromiter(map(crc32, map(words.__getitem__, which.tolist()), map(starts.__getitem__, runs.doc.tolist())), np.int64, len(which))
            hit = hashes % SEED == 0
            whole = np.bincount(which[~hit], minlength=len(words)).tolist()
            cut: Counter[str] = Counter()
            for w, h in zip(which[hit].tolist(), hashes[hit].tolist()):
                word = words[w].decode()
                cut[word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
            kept = [(word, n) for word, n in zip((w.decode() for w in words), whole) if n and len(word) >= least_length]
            kept += [(word, n) for word, n in cut.items() if len(word) >= least_length]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, *, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word and n of the words of docs(doc_id, text) of at least least_length code points and least_count occurrences."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(lambda batches: counted_runs(batches, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def part_hashes(words: list[str]) -> np.ndarray:
    """A row for each word: hashes of the dimensions of its letter vector that each part holds."""
    point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    order = np.lexsort((point, word))
    point, word = point[order], word[order]
    first = np.ones(len(point), bool)
    first[1:] = (point[1:] != point[:-1]) | (word[1:] != word[:-1])
    place = np.arange(len(point)) - np.maximum.accumulate(np.where(first, np.arange(len(point)), 0))
    dims = mix((point << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
    found = np.zeros((len(words), PARTS), np.uint64)
    np.bitwise_xor.at(found, (word, (dims % np.uint64(PARTS)).astype(np.int64)), dims)
    return found


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        words = batch.column(0).to_pylist()
        parts = part_hashes(words)
        for side in (0, 1):
            ends = np.array([crc32((w[:ENDS] if side == 0 else w[-ENDS:]).encode()) for w in words], np.uint64)
            for k, drop in enumerate(DROPS):
                sig = mix(ends + (np.uint64(k * 2 + side) << np.uint64(32)))
                for p in range(PARTS):
                    if p not in drop:
                        sig = mix(sig * odd + parts[:, p])
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), *batch.columns], ["sig", "word", "n"])


def signatures(words: DataFrame) -> DataFrame:
    """sig, word and n: the signatures of words(word, n), one of each two dropped parts and end of the word."""
    return words.select("word", "n").mapInArrow(_signed, "sig long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n for each pair of words(word, n), a < b, of edit distance 1; words are distinct and of 2 * ENDS code points or more.

    Both sides of the join are one shuffle. Words that share several signatures meet in each, so pairs are made distinct at the end.
    """
    marked = signatures(words)
    near = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.word") < F.col("y.word")) & (F.levenshtein("x.word", "y.word", 1) == 1)
    met = marked.alias("x").join(marked.alias("y").hint("merge"), near)
    return met.select(F.col("x.word").alias("a"), F.col("y.word").alias("b"), F.col("x.n").alias("a_n"), F.col("y.n").alias("b_n")).distinct()


def spelling_variants(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of docs(doc_id, text).

    Words are the letter runs of whole texts, as in `counted_runs`, of least_length (6 or more) code
    points and least_count occurrences over all rows. A word's form is its near word (edit distance
    1) of largest n, of equal ones the first by code point, if its n is `ratio` times the word's n or
    more, else null; root follows forms to the last. Null texts have no words, a null doc_id counts
    as an empty one; rows that repeat a doc_id count each. A table without words gives no rows.
    Extra columns are ignored. Texts are read in slices of about 2 MB, a longer text alone.
    """
    if least_length < 2 * ENDS:
        raise ValueError(f"words need {2 * ENDS} code points at least")
    words = written(vocabulary(docs, least_length=least_length, least_count=least_count))
    pairs = written(near_pairs(words))
    both = pairs.union(pairs.select("b", "a", "b_n", "a_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("key"), "b", "b_n"))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    fits = F.col("best.b_n") >= ratio * F.col("n")
    formed = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.b")).alias("form"), F.when(fits, F.col("best.b_n")).alias("form_n")))
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms of each word of steps(word, form).

    A form's n is a multiple of its word's, so chains end and are short; each round doubles the steps taken.
    """
    state = written(steps.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        state = moved.select("word", "root")


# DuckDB lacks crc32 and its levenshtein counts bytes, so letters beyond ASCII become ASCII ones before it.
VARIANTS_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) - 64 AS BIGINT)] END))),
    lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1]))) AS h FROM runs, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
  CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1),
kept AS (SELECT word, n, translate(word, 'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß',
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}') AS plain
  FROM words WHERE length(word) >= 6 AND n >= 5),
near AS (SELECT a.word, b.word AS other, b.n AS other_n, row_number() OVER (PARTITION BY a.word ORDER BY b.n DESC, b.word) AS place, count(*) OVER (PARTITION BY a.word) AS n_near
  FROM kept a JOIN kept b ON abs(length(a.plain) - length(b.plain)) <= 1
   AND (left(a.plain, 3) = left(b.plain, 3) OR right(a.plain, 3) = right(b.plain, 3)) AND levenshtein(a.plain, b.plain) = 1),
formed AS (SELECT k.word, k.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.other_n >= 5 * k.n THEN m.other END AS form, CASE WHEN m.other_n >= 5 * k.n THEN m.other_n END AS form_n
  FROM kept k LEFT JOIN near m ON k.word = m.word AND m.place = 1),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON w.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walk w JOIN formed f ON w.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e USING (word)
"""
