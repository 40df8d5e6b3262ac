"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased, everything else ends a word; a letter or a word's end is predicted from
up to three symbols before it in its word. Each order's grams are hashed into one sorted array for
all languages, with a row of interpolated log probabilities, one column a language; a gram that no
language has seen falls back through arrays of context weights. The language with the lowest
cross-entropy per symbol wins. A temperature fitted on labelled documents that the models have not
seen calibrates the score, and their spread of cross-entropies gives the bound for rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Words, mix, shipped, slices, text_buffers

UNDETERMINED = "und"
MASKS = {4: (1 << 64) - 1, 3: (1 << 48) - 1, 2: (1 << 32) - 1, 1: (1 << 16) - 1}


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def symbols_of(words: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram keys of predicted symbols, number of them for each word); 16 bits a symbol, 0 a word's end. Letters beyond 16 bits share symbols with others."""
    lowered = [w.lower() for w in words]
    sizes = np.array([len(w) + 1 for w in lowered], dtype=np.int64)
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    s = np.where(is_letter[points], np.where(points > 0xFFFF, 1 + points % 0xFFFF, points), 0).astype(np.uint64)
    zero = np.zeros(3, dtype=np.uint64)
    padded = np.concatenate([zero, s])
    p1 = padded[2:-1]
    p2 = np.where(p1 == 0, np.uint64(0), padded[1:-2])
    p3 = np.where(p2 == 0, np.uint64(0), padded[:-3])
    keys = p3 << np.uint64(48) | p2 << np.uint64(32) | p1 << np.uint64(16) | s
    told = (s != 0) | (p1 != 0)
    n = np.add.reduceat(told.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(words) else np.zeros(0, np.int64)
    return keys[told], n


class Lookup:
    """Sorted hash array of keys with one row each; absent keys have the row `default`."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, default: np.ndarray) -> None:
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.rows = np.concatenate([rows[order], default[None]]).astype(np.float32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        hashes = mix(keys)
        at = np.searchsorted(self.hashes, hashes)
        found = at < len(self.hashes)
        found[found] = self.hashes[at[found]] == hashes[found]
        return np.where(found, at, len(self.hashes))


@dataclass
class Model:
    langs: list[str]
    grams: dict[int, Lookup]
    weights: dict[int, Lookup]
    temperature: float = 1.0
    bound: np.ndarray | None = None

    def log_probabilities(self, keys: np.ndarray, order: int = 4) -> np.ndarray:
        """keys x languages, natural logarithms."""
        table = self.grams[order]
        at = table.places(keys)
        out = table.rows[at].astype(np.float64)
        gone = np.flatnonzero(at == len(table.hashes))
        if order > 1 and len(gone):
            lower = keys[gone] & np.uint64(MASKS[order - 1])
            context = keys[gone] >> np.uint64(16)
            weights = self.weights[order]
            out[gone] = weights.rows[weights.places(context)] + self.log_probabilities(lower, order - 1)
        return out


def fit_models(counts: pd.DataFrame, langs: list[str]) -> Model:
    """Interpolated Kneser-Ney models from counts(lang, gram, n) of 4-grams."""
    index = {lang: i for i, lang in enumerate(langs)}
    keys = counts["gram"].to_numpy().astype(np.int64).view(np.uint64)
    own = counts["lang"].map(index).to_numpy().astype(np.int64)
    n = counts["n"].to_numpy().astype(np.float64)
    levels = {4: (own, keys, n)}
    for order in (3, 2, 1):
        lang, gram, raw = levels[order + 1]
        lower = gram & np.uint64(MASKS[order])
        # a gram at the start of a word has one left neighbour only: its own count stands
        starts = (gram >> np.uint64(16 * (order - 1))) & np.uint64(0xFFFF) == 0 if order > 1 else np.zeros(len(gram), bool)
        frame = pd.DataFrame({"lang": lang, "gram": lower, "n": np.where(starts, raw, 1.0)}).groupby(["lang", "gram"], sort=True)["n"].sum().reset_index()
        levels[order] = frame["lang"].to_numpy(), frame["gram"].to_numpy().astype(np.uint64), frame["n"].to_numpy()
    grams: dict[int, Lookup] = {}
    weights: dict[int, Lookup] = {}
    model = Model(langs, grams, weights)
    unit = np.ones(len(langs))
    for order in (1, 2, 3, 4):
        lang, gram, c = levels[order]
        once, twice = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        context = gram >> np.uint64(16) if order > 1 else np.zeros(len(gram), np.uint64)
        kinds, place = np.unique(context, return_inverse=True)
        total = np.zeros((len(kinds), len(langs)))
        types = np.zeros_like(total)
        np.add.at(total, (place, lang), c)
        np.add.at(types, (place, lang), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(total > 0, discount * types / total, 1.0)
        union, at = np.unique(gram, return_inverse=True)
        direct = np.zeros((len(union), len(langs)))
        of_union = union >> np.uint64(16) if order > 1 else np.zeros(len(union), np.uint64)
        row = np.searchsorted(kinds, of_union)
        np.add.at(direct, (at, lang), np.maximum(c - discount, 0) / total[place, lang])
        if order == 1:
            base = np.full((len(union), len(langs)), 1 / (4 * len(union) + 100))
            lost = np.log(left[0] / (4 * len(union) + 100))
        else:
            base = np.exp(model.log_probabilities(union & np.uint64(MASKS[order - 1]), order - 1))
            lost = np.zeros(len(langs))
            weights[order] = Lookup(kinds, np.log(left), np.log(unit))
        grams[order] = Lookup(union, np.log(direct + left[row] * base), lost)
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for batch in batches:
        labels, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, j in slices(text_buffers(texts)[1]):
            said = texts[i:j].to_pylist()
            for lang in sorted(set(labels[i:j])):
                keys, _ = symbols_of([t for t, x in zip(said, labels[i:j], strict=True) if x == lang], letters)
                grams, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def text_scores(model: Model, texts: pa.Array, hasher: Hasher, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: log probability by language, predicted symbols, and whether it has a letter."""
    raw, offsets = text_buffers(texts)
    scores, symbols = [], []
    for i, j in slices(offsets):
        words = Words(hasher, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        # words repeat: each different one is scored once
        _, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        keys, n = symbols_of([words.text(k).decode("utf-8", "replace") for k in first], letters)
        ends = np.cumsum(n)
        own = np.zeros((len(n) + 1, len(model.langs)))
        if len(keys):
            totals = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(model.log_probabilities(keys), axis=0)])
            own[1:] = totals[ends] - totals[ends - n]
        own, n = own[1:], n
        sums = np.zeros((j - i, len(model.langs)))
        for k in range(len(model.langs)):
            sums[:, k] = np.bincount(words.doc, own[back, k], j - i) if len(back) else 0
        scores.append(sums)
        symbols.append(np.bincount(words.doc, n[back], j - i) if len(back) else np.zeros(j - i))
    if not scores:
        return np.zeros((0, len(model.langs))), np.zeros(0), np.zeros(0, bool)
    total = np.concatenate(symbols)
    return np.concatenate(scores), total, total > 0


def held_part(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def posterior(scores: np.ndarray, temperature: float) -> np.ndarray:
    z = scores * temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, *, sample_docs: int = 4000, most_docs: int = 32000) -> Model | None:
    """Models from documents of the training parts with a lang; None without any.

    About `sample_docs` documents of each language, by hash of the id, fit the models, and as many
    of another part calibrate them; fewer where all languages together would pass `most_docs`.
    These two are the documented bound: all their grams are learned, of every language.
    """
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").withColumn("part", held_part(4)).where("part <> 2")
    sizes = labelled.groupBy("lang", (F.col("part") == 3).alias("calibrates")).count()
    seen = sizes.collect()  # two rows a language
    if not seen:
        return None
    own = min(sample_docs, max(20, most_docs // len({r["lang"] for r in seen})))
    share = {(r["lang"], r["calibrates"]): min(1.0, own / r["count"]) for r in seen}
    chain = F.lit(0.0)
    for (lang, calibrates), x in share.items():
        chain = F.when((F.col("lang") == lang) & ((F.col("part") == 3) == calibrates), x).otherwise(chain)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < chain * (1 << 20)
    some = labelled.where(drawn).select("lang", "text", "part")
    fits = some.where("part <> 3").select("lang", "text")
    counts = fits.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.orderBy("lang", "gram").toPandas()
    if not len(counts):
        return None
    model = fit_models(counts, sorted(counts["lang"].unique().tolist()))
    calibrate(model, some.where("part = 3").select("lang", "text"))
    return model


def calibrate(model: Model, held: DataFrame) -> None:
    """Set the temperature by likelihood, and the rejection bound by the spread of cross-entropies."""
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, letters = Hasher(), letter_table()
        for batch in batches:
            scores, n, has = text_scores(model, batch.column(1), hasher, letters)
            rows = pa.array(scores.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(n.astype(np.float64))], ["lang", "scores", "n"])

    seen = held.mapInArrow(run, "lang string, scores array<double>, n double").where(F.col("n") > 0).where(F.col("lang").isin(langs)).toPandas()
    model.bound = np.full(len(langs), np.inf)
    if not len(seen):
        return
    scores = np.stack(seen["scores"].to_list())
    truth = seen["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    options = [2.0**-k for k in range(13)]
    loss = [-np.log(np.maximum(posterior(scores, t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in options]
    model.temperature = options[int(np.argmin(loss))]
    entropy = -scores[np.arange(len(truth)), truth] / seen["n"].to_numpy()
    for i in range(len(langs)):
        own = entropy[truth == i]
        if len(own) >= 20:
            model.bound[i] = 1.25 * np.quantile(own, 0.999)


def identified(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs(doc_id, text).

    A null text or one without a letter is `und` with score 0; so is every text when no model could
    be learned. A prediction reads the text alone. rejected marks `und`, scores below a half and
    cross-entropies beyond the bound of their language (wider for short texts). Repeated rows get
    a row each; `keep` lists columns to carry along beside the new ones, others are ignored.
    """
    shared = shipped(docs.sparkSession, model)
    carried = docs.select(*(F.col(c) for c in keep)) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = carried.columns
    at_text = names.index("text")
    out = [c for c in names if keep or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, letters, own = Hasher(), letter_table(), shared()
        for batch in batches:
            size = batch.num_rows
            pred, score, no = np.full(size, UNDETERMINED, dtype=object), np.zeros(size), np.ones(size, dtype=bool)
            if own is not None and size:
                scores, n, has = text_scores(own, batch.column(at_text), hasher, letters)
                at = np.flatnonzero(has)
                if len(at):
                    best = scores[at].argmax(axis=1)
                    sure = posterior(scores[at], own.temperature)[np.arange(len(at)), best]
                    entropy = -scores[at, best] / n[at]
                    pred[at] = np.array(own.langs, dtype=object)[best]
                    score[at] = sure
                    no[at] = (sure < 0.5) | (entropy > own.bound[best] + 6 / np.sqrt(n[at]))
            columns = [batch.column(i) for i, c in enumerate(names) if c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(no)], [*out, "lang_pred", "score", "rejected"])

    shape = carried.select(*out).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    found = carried.mapInArrow(run, shape)
    return found.select(*out, F.coalesce(held_part(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def identify(docs: DataFrame, **options: int) -> DataFrame:
    """Train on the training parts of docs(doc_id, text, lang) and identify every row."""
    return identified(docs, train(docs, **options))
