import random
import re

from tidemark.llm.graph import connected_components
from tidemark.llm.neardup import near_duplicates


def brute_force(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets))


def corpus():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    bases = [[r.choice(vocab) for _ in range(r.randint(30, 200))] for _ in range(12)]
    for base in bases:
        for _ in range(14):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocab)
            rows.append((n, " ".join(words)))
            n += 3
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "One\ttwo"), (n + 5, "one two three")]
    rows += [(n + 6, "long " * 60000), (n + 7, "é" * 5000)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    for width in (4, 5):
        got = sorted(tuple(r) for r in near_duplicates(df, width=width).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == brute_force(rows, width, 80)


def test_pairs_within_a_family_of_half_similar_documents(spark):
    r = random.Random(11)
    pool = [[f"p{i}x{k}" for k in range(12)] for i in range(16)]
    texts = []
    for _ in range(800):
        texts.append([w for i in sorted(r.sample(range(16), 9)) for w in pool[i]])
    for words in texts[700:800]:
        copy = list(words)
        for at in (17, 60):
            copy[at] = f"c{r.random()}"
        texts.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    part = {x.doc_id: x.component_id for x in near_duplicates(df, rows=2).collect()}  # short bands: third documents lead nearly all buckets
    assert sum(part[700 + i] != part[800 + i] for i in range(100)) == 0


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == [(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "u long, v long")
    got = dict(connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_a_repeated_doc_id_is_one_document_and_null_ids_link_by_text(spark):
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(5000)]
    one, two, far = ([r.choice(vocab) for _ in range(200)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], "changed"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (5, " ".join(far)), (None, near(far)), (None, "quite alone here"), (None, "quite alone here"), (None, None), (9, "quite alone here too"), (9, "quite alone here too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shuffled in (df, df.repartition(4), df.orderBy("text")):
        got = sorted(((x.doc_id, x.component_id, x.kept) for x in near_duplicates(shuffled).collect()), key=str)
        want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (9, 9, True), (9, 9, True), (None, 5, False), (None, None, True), (None, None, True), (None, None, True)]
        assert got == sorted(want, key=str)


def test_carried_columns_judge_rows_by_their_text(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(1, words, b"a"), (1, "other text of five words", b"b"), (2, words, b"c"), (None, None, b"d")]
    got = {x.key: (x.component_id, x.group) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key binary"), carry=("key",)).collect()}
    groups = {bytes(k): g for k, (_, g) in got.items()}
    assert groups[b"a"] == groups[b"c"] != groups[b"b"] and groups[b"d"] is None
