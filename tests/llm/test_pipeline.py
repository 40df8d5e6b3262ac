import random
import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if not name.startswith("mixing"):
            assert docs.count() <= before
        before = docs.count()
        assert before > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == before and out.where("size(ids) <> n_tokens").count() == 0


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key long, component_id long, row long, size long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def fixture(n=90):
    r = random.Random(9)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [r.choice(pool) for _ in range(r.randint(60, 90))]
        rows.append((i * 2 + 1, " ".join(words)))
        if i % 3 == 0:
            words[r.randrange(len(words))] = "other"
            rows.append((i * 2, " ".join(words).upper()))
    rows += [(None, rows[0][1]), (None, "only " + " ".join(pool[:40])), (None, "only " + " ".join(pool[:40])), (7, "one text " + " ".join(pool[50:99])), (7, "quite another " + " ".join(pool[100:160])), (500, None), (500, None), (501, ""), (None, None), (502, " \n")]
    return [(i, t, "en", f"s{k % 3}", len(t or ""), True, 1, 2, 3, 4) for k, (i, t) in enumerate(rows)]


def test_dedup_equals_brute_force_and_reruns_agree(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SHAPE)
    runs = [sorted(map(str, corpus_pipeline.dedup_stage(spark, d, SF).collect())) for d in (docs, docs.repartition(5, "source", "n_chars"))]
    assert runs[0] == runs[1]
    each = sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, str(x[1])))
    sets, label = [shingles(t) for _, t in each], list(range(len(each)))
    for a in range(len(each)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    want = [each[i] for i, x in enumerate(label) if i == x]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stages_take_empty_tables_nulls_and_other_columns(spark):
    docs = spark.createDataFrame(fixture(30), SHAPE)
    for table in (docs, docs.limit(0), docs.where("text is null")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= 3 * table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    kept = {(r["doc_id"], r["text"]) for r in docs.collect()}
    import hashlib

    assert {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept} == {(r["doc_id"], r["decoded_sha256"]) for r in out.collect()}
