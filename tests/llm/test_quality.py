import random
import re

from tidemark.llm.quality import base_failed, learn_rules, quality_rules, text_statistics, verdict

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    words = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def texts():
    r = random.Random(2)
    out = [None, "", " \n\t ", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n x\n\n\n", "é # ü|ß\x0bß\x0cß", "b a " * 40]
    for _ in range(60):
        out.append("".join(r.choice(["the", "of", "and", "é", "#", "x|y"]) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.randint(0, 60))))
    return out


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(dict(rows)[r["doc_id"]]), r


def test_learned_list_rejects_junk_and_keeps_clean(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(600):
        words = [r.choice(vocab) for _ in range(r.randint(60, 120))]
        bad = i % 6 == 0
        docs.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "mine"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    docs.append((None, None, "mine"))
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    judged, rules = quality_rules(df.drop("kept"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules
    got = {x["doc_id"]: x["kept"] for x in judged.select("doc_id", "kept").collect()}
    assert not got[None]
    assert all(got[i] == (i % 6 != 0) for i in range(600))


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "w " * 60)], "doc_id long, text string")
    judged, rules = quality_rules(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert rules == [] and [x["kept"] for x in judged.collect()] == [False]  # all its windows repeat
    assert quality_rules(df.limit(0), spark.createDataFrame([], "doc_id long, quality int"))[0].count() == 0
