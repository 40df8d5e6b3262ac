import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import langid, lm

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORDS = {
    "en": ["the", "of", "and", "there", "nation", "thing", "other", "when", "water"],
    "fr": ["les", "des", "une", "être", "nation", "chose", "autre", "quand", "l'eau"],
    "de": ["der", "die", "das", "über", "nation", "sache", "andere", "wann", "wasser"],
}


def corpus(n=240):
    r = random.Random(6)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(r.choice(WORDS[lang]) + r.choice(["", "", ".", "s"]) for _ in range(r.randint(5, 60))), lang, "s"))
    return rows + [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "123 !!", "en", "s"), (1003, "wasser " * 20000, None, "s"), (1004, "The WATER 水 thing", "en", "s")]


def test_language_held_out(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    for i, _, lang, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if i < 1000:
            assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "de"
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.where("lang is null")).collect()} == {"und"}


def test_models_are_distributions():
    import pandas as pd

    keys, _ = langid.symbols_of(WORDS["en"] + WORDS["en"][:4], langid.letter_table())
    grams, n = np.unique(keys, return_counts=True)
    model = langid.fit_models(pd.DataFrame({"lang": "en", "gram": grams.view(np.int64), "n": n}), ["en"])
    seen = model.grams[1].hashes
    symbols = np.array(sorted({int(k & np.uint64(0xFFFF)) for k in keys}), dtype=np.uint64)
    assert len(symbols) == len(seen)
    for context in {int(k >> np.uint64(16)) for k in keys}:
        p = np.exp(model.log_probabilities(symbols | np.uint64(context << 16))).sum()
        assert 0.7 < p <= 1 + 1e-6  # the rest is for letters never seen


def test_base_scores_equal_brute_force_and_the_model_beats_them(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in lm.score_texts(df, most_words=8).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<end>"] for i, t, *_ in rows}
    counts = Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    held = 0.0
    for i, own in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(counts[t] > 0 for t in own)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
        if r["held_out"]:
            held += r["score"] - base
    assert held > 0
    assert lm.score_texts(df.limit(0)).count() == 0


def speller(words, classes):
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    keys, n = lm.spelled(data, np.cumsum(size) - size, np.cumsum(size))
    z = np.repeat(np.array(classes, dtype=np.uint64), n)
    kinds, m = np.unique(keys | z << np.uint64(40), return_counts=True)
    keys, z, byte = kinds & np.uint64((1 << 40) - 1), kinds >> np.uint64(40), (kinds & np.uint64(255)).astype(np.int64)
    table = lm.BitTable(lm.ByteCode(np.bincount(byte, m, 256)))
    for context in lm.contexts(keys, z):
        table.add(context, byte, m.astype(float))
    after = np.unique(np.array([(97 << 24 | 98 << 16 | w[0], 97 << 24 | 98 << 16 | w[0] << 8 | w[1]) for w in words], dtype=np.uint64).ravel())
    table.add(lm.word_context(after, np.ones(len(after), np.uint64)), (after & np.uint64(255)).astype(np.int64), np.full(len(after), 3.0))
    r = np.random.default_rng(4)
    return lm.Speller(table, r.uniform(0.1, 0.5, (lm.GATES, lm.INPUTS)).astype(np.float32))


def bit_by_bit(model, keys, after, z):
    """One segment, coded one decision after another with plain numbers."""
    code, w = model.table.code, model.weights.astype(float).copy()
    refine = [[1 / (1 + math.exp(-(j - 16) / 2)) for j in range(33)] for _ in range(5)]
    out = []
    for key, tail in zip(keys, after):
        total, byte = 0.0, int(key) & 255
        for d in range(code.length[byte]):
            node, bit = code.nodes[byte, d : d + 1], int(code.bits[byte, d])
            counts = [model.table.look(c, node)[0].astype(float) for c in lm.contexts(np.array([key]), z)]
            x = [math.log((c[1] + 0.4) / (c[0] + 0.4)) for c in counts]
            c = model.table.look(lm.word_context(np.array([tail]), z), node)[0].astype(float) if tail else [0, 0]
            x += [math.log((c[1] + 0.4) / (c[0] + 0.4)), 0.3]
            level = [sum(c.sum() > b for b in (0.5, 2.5, 10.5, 60.5)) for c in counts[-2:]]
            gate = level[0] * 5 + level[1]
            s = max(-7.99, min(7.99, sum(a * b for a, b in zip(w[gate], x))))
            p = 1 / (1 + math.exp(-s))
            low = int((s + 8) * 2)
            share = (s + 8) * 2 - low
            own = refine[level[1]]
            q = (p + own[low] + share * (own[low + 1] - own[low])) / 2
            total += math.log(q if bit else 1 - q)
            w[gate] += 0.02 * (bit - p) * np.array(x)
            own[low + (share > 0.5)] += 0.02 * (bit - own[low + (share > 0.5)])
        out.append(total)
    return np.array(out)


def test_segments_in_step_equal_one_bit_after_another(monkeypatch):
    words = [w.encode() for own in WORDS.values() for w in own]
    model = speller(words, [1] * len(words))
    r = random.Random(5)
    texts = [" ".join(r.choice(words).decode() + r.choice(["", "er", "x9", "ab"]) for _ in range(n)) for n in (1, 40, 7, 0, 90, 3)]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    monkeypatch.setattr(lm, "SEGMENT", 64)
    for at_once in (50, 1 << 20):
        monkeypatch.setattr(lm, "AT_ONCE", at_once)
        found = lm.Words(lm.Hasher(), np.frombuffer(raw, np.uint8), offsets)
        rare = np.arange(len(found.start))
        got = np.zeros(len(rare))
        for some, logp, _, _ in model.words(found, rare, np.ones(len(rare), np.int64)):
            got[some] = logp
        want = []
        tails = lm.tails(found)
        for d in range(len(texts)):
            keys, after, ends, used = [], [], [], 0
            segments = {}
            for i in range(found.bounds[d], found.bounds[d + 1]):
                k, n = lm.spelled(found.data, found.start[i : i + 1], found.end[i : i + 1])
                segments.setdefault(used // 64, []).append((k, lm.after_words(tails[i : i + 1], k, n)))
                used += len(k)
            for own in segments.values():
                logs = bit_by_bit(model, np.concatenate([k for k, _ in own]), np.concatenate([a for _, a in own]), 1)
                at = 0
                for k, _ in own:
                    want.append(logs[at : at + len(k)].sum())
                    at += len(k)
        assert np.allclose(got, want, rtol=2e-4, atol=2e-4)


def test_bytes_sum_to_one():
    words = [w.encode() for own in WORDS.values() for w in own]
    model = speller(words, [1] * len(words))
    for key in lm.spelled(np.frombuffer(b"there", np.uint8), np.array([0]), np.array([5]))[0]:
        keys = key & ~np.uint64(255) | np.arange(256, dtype=np.uint64)
        logs = model.code(keys, np.zeros(256, np.uint64), np.ones(256, np.int64), np.arange(256))[0]
        assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_held_out_score_passes_the_base_on_the_table(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.queries import op4_lm_scoring

    held = op4_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_texts_sum_to_one_while_the_class_is_unsure(spark):
    """All texts of up to four of five words, where one word is frequent and the others are counted and spelled."""
    import itertools

    from pyspark.sql import functions as F

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    ids = [i for i in range(2000) if not held(i)]
    rows = [(i, "x", "a") for i in ids[:40]] + [(i, f"r{i % 4}", "b") for i in ids[40:84]]
    tried = [i for i in range(2000, 9000) if held(i)]
    texts = [" ".join(t) for n in range(5) for t in itertools.product(("x", "r0", "r1", "r2", "r3"), repeat=n)]
    assert len(texts) == 781
    rows += [(i, t, None) for i, t in zip(tried, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (1, 2, 1 << 10):
        total = lm.score_texts(df, most_words=most).where(F.col("doc_id") >= 2000).agg(F.sum(F.pow(F.lit(10.0), "score"))).first()[0]
        assert 0.5 < total <= 1 + 1e-5


def test_odd_rows_of_models(spark):
    rows = [(None, "the water", "en", 1), (5, "the water", "en", 2), (5, "the water", "en", 2), (6, None, None, 3), (7, "x" * 30000, "en", 4), (8, "\x00 a", "fr", 5), (9, "𐐀𐐁 𠀀 𰀀", None, 6)]
    rows += [(i, "the other water", "en", 0) for i in range(20, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    for query in (lm.score_texts, langid.identify):
        got = query(df).collect()
        assert len(got) == len(rows)
        same = [tuple(r) for r in got if r["doc_id"] == 5]
        assert same[0] == same[1]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert found[9] != "und" and found[6] == "und"


def test_letters_of_all_planes():
    letters = langid.letter_table()
    for c in (0x10000, 0x20000, 0x30000, 0x1FFFF + 1, ord("a"), 0xFFFF + 1):
        assert letters[c] == chr(c).isalpha()
        keys, _ = langid.symbols_of([chr(c)], letters)
        assert (len(keys) > 0) == chr(c).isalpha() and all(int(k) & 0xFFFF for k in keys[:1])


def test_executors_without_the_package(tmp_path):
    """Workers that can't import the package score, identify and link: models go by value."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from tidemark.llm import embeddings, langid, lm
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
def lacks(frames):
    import importlib.util
    for frame in frames:
        yield frame.assign(doc_id=int(importlib.util.find_spec("tidemark") is not None))
docs = spark.createDataFrame([(i, "the water of the nation " * 3, "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
assert docs.select("doc_id").mapInPandas(lacks, "doc_id long").agg({{"doc_id": "max"}}).first()[0] == 0
assert lm.score_texts(docs).count() == 40 and langid.identify(docs).count() == 40
lm.score_texts(docs).collect(), langid.identify(docs).collect()
vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(40)], "vec_id long, embedding array<double>")
assert len(embeddings.near_vectors(vectors).collect()) == 40
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_first_weights_are_fitted_on_all_grams_of_the_training_documents(spark):
    words = [w.encode() for own in WORDS.values() for w in own]
    table = speller(words, [1] * len(words)).table
    size = np.array([len(w) for w in words])
    keys, _ = lm.spelled(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, np.cumsum(size))
    kinds, n = np.unique(keys | np.uint64(1 << 40), return_counts=True)
    begun = sorted({97 << 24 | 98 << 16 | w[0] | 1 << 40 for w in words} | {97 << 24 | 98 << 16 | w[0] << 8 | w[1] | 1 << 40 for w in words})
    grams = spark.createDataFrame(list(zip(kinds.view(np.int64).tolist(), n.tolist())), "gram long, n long").repartition(3)
    got = lm.first_weights(grams, spark.createDataFrame([(g, 4) for g in begun], "gram long, n long"), table)

    low = (1 << 40) - 1
    rows = [(int(g) & low, 0, float(m)) for g, m in zip(kinds, n) if (int(g) & low) >> 16]
    share = sum(float(m) for g, m in zip(kinds, n) if not (int(g) & low) >> 16) / (4 * len(begun))
    rows += [(g & 0xFFFF, g & low, 4 * share) for g in begun]
    xs, ys, ms = ([[] for _ in range(lm.GATES)] for _ in range(3))
    for key, tail, m in rows:
        byte = key & 255
        for d in range(table.code.length[byte]):
            node, bit = table.code.nodes[byte, d : d + 1], int(table.code.bits[byte, d])
            seen = [table.look(c, node)[0].astype(float) for c in lm.contexts(np.array([key], np.uint64), 1)]
            seen.append(table.look(lm.word_context(np.array([tail], np.uint64), 1), node)[0].astype(float) if tail else np.zeros(2))
            level = []
            for k, c in enumerate(seen):
                c[bit] = max(c[bit] - 1, 0)
                level += [sum(c.sum() > b for b in (0.5, 2.5, 10.5, 60.5))] if k in (2, 3) else []
            gate = level[0] * 5 + level[1]
            xs[gate].append([math.log((c[1] + 0.4) / (c[0] + 0.4)) for c in seen] + [0.3])
            ys[gate].append(bit)
            ms[gate].append(m)
    for gate in range(lm.GATES):
        x, y, m = np.array(xs[gate]).reshape(-1, lm.INPUTS), np.array(ys[gate]), np.array(ms[gate])
        loss = lambda w: (m * np.logaddexp(0, (1 - 2 * y) * (x @ w))).sum() + lm.HOLD / 2 * ((w - 0.3) ** 2).sum()  # noqa: B023, E731
        # the loss is convex, so no weight may gain by a small move
        moves = [loss(got[gate] + d * np.eye(lm.INPUTS)[j]) for d in (-0.02, 0.02) for j in range(lm.INPUTS)]
        assert loss(got[gate]) <= min(moves), gate
