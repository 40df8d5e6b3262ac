import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from tidemark.llm.queries import op12_spelling_variants
from tidemark.llm.spelling import DROPS, PARTS, VARIANTS_SQL, near_pairs, part_hashes, spelling_variants

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, word string, n int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    found = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(found)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def text_rows(seed):
    r = random.Random(seed)
    stems = ["thering", "atement", "élèvement", "informa", "aaaaaaa", "aaaaaaab", "gniretht"]
    rows = []
    for i in range(220):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + r.choice("aeié") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("nrtÿ") + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "_", "1", "Ā", "\n"]).join(words), "x", 1))
    return rows


def test_equals_brute_force(spark):
    rows = text_rows(1) + [(900, None, "x", 1), (901, "", "x", 1), (None, "Thering thering 1 \U0001f600 ×÷×÷×÷" * 6, "x", 1)]
    rows += [(5, "thering " * 30, "x", 1)] * 2
    assert got(spelling_variants(spark.createDataFrame(rows, SHAPE).repartition(5))) == brute(rows)


def test_chains_of_forms_reach_the_last(spark):
    steps = [("abcdefgh", 2000), ("abcdefg", 400), ("abcdef", 80), ("abcdex", 16)]
    rows = [(10**6, " ".join(w for w, n in steps for _ in range(n)), "x", 1)]
    want = brute(rows)
    assert {w[0]: w[2] for w in want}["abcdex"] == "abcdefgh"
    assert got(spelling_variants(spark.createDataFrame(rows, SHAPE))) == want


def test_long_runs_and_no_words(spark):
    rows = [(i, "ab" * 40000 + " " + "ab" * 40000 + "c", "x", 1) for i in range(6)]
    assert got(spelling_variants(spark.createDataFrame(rows, SHAPE))) == brute(rows)
    assert spelling_variants(spark.createDataFrame([(1, "a b", "x", 1)], SHAPE)).count() == 0
    assert spelling_variants(spark.createDataFrame([], SHAPE)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], SHAPE), least_length=5)


def test_words_one_edit_apart_share_a_signature():
    r = random.Random(3)
    for _ in range(300):
        w = "".join(r.choice("abcdeé") for _ in range(r.randrange(6, 14)))
        k = r.randrange(len(w))
        v = r.choice([w[:k] + "x" + w[k:], w[:k] + w[k + 1 :], w[:k] + "y" + w[k + 1 :]])
        a, b = part_hashes([w, v])
        assert any(all(a[p] == b[p] for p in range(PARTS) if p not in drop) for drop in DROPS)


def test_each_pair_comes_once(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=7)) for i in range(90)})
    pairs = near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).select("a", "b").collect()
    assert sorted(tuple(p) for p in pairs) == [(a, b) for a in words for b in words if a < b and one_edit(a, b)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({VARIANTS_SQL})").fetchall(), key=str)
    assert sorted(got(op12_spelling_variants(spark, SF)), key=str) == want
