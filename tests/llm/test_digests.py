import hashlib

import duckdb

from tidemark.llm.digests import DEDUP_SQL, DigestIndex, exact_duplicates, text_digest
from tidemark.llm.queries import op11_exact_dedup

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, keep_id string, digest int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(lowered(text), []).append(i)
    return groups


def test_equals_brute_force_with_a_hot_text_and_odd_rows(spark):
    rows = [(i, "The SAME text" if i % 3 == 0 else f"text {i % 41} É", "x", 1) for i in range(900)]
    rows += [(2000, None, "x", 1), (2001, "", "x", 1), (2002, "A" * 300000, "x", 1), (2003, "a" * 300000, "x", 1), (2004, "text 5 é", "x", 1)]
    got = exact_duplicates(spark.createDataFrame(rows, SHAPE).repartition(7)).collect()
    groups = brute(rows)
    text_of = {r[0]: lowered(r[1]) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        group = groups[text_of[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
        assert r.text_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest()


def test_repeated_and_null_ids_keep_one_row_of_a_text(spark):
    rows = [(7, "a", "x", 1), (7, "A", "x", 1), (7, "b", "x", 1), (None, "a", "x", 1), (None, "c", "x", 1), (None, "c", "x", 1), (-3, "d", "x", 1)]
    got = exact_duplicates(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(got) == 7
    kept = sorted((str(r.doc_id), r.text_sha256) for r in got if r.kept)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert kept == sorted([("7", sha("a")), ("7", sha("b")), ("None", sha("c")), ("-3", sha("d"))])
    assert {r.group_size for r in got if r.text_sha256 == sha("a")} == {3}
    assert exact_duplicates(spark.createDataFrame([], SHAPE)).count() == 0


def test_index_persists_and_a_batch_repeated_appends_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    first = exact_duplicates(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), index=DigestIndex(spark, path, 4))
    assert all(r.kept for r in first.collect())
    spark.catalog.dropTempView("none")
    spark.sql(f"DROP TABLE {DigestIndex(spark, path, 4).table}")  # external: the files stay, as for another session
    index = DigestIndex(spark, path, 4)
    got = {r.doc_id: r for r in exact_duplicates(spark.createDataFrame([(9, "A"), (3, "c")], "doc_id long, text string"), index=index).collect()}
    assert (got[9].keep_id, got[9].kept, got[9].group_size) == (1, False, 1)
    assert (got[3].keep_id, got[3].kept) == (3, True)
    from pyspark.sql import functions as F

    again = spark.createDataFrame([(9, "A", 0), (3, "c", 1)], "doc_id long, text string, place long").select(text_digest(F.col("text")).alias("digest"), "doc_id", "place")
    assert index.add(again, 50).count() == 0
    assert index.rows().count() == 3


def test_index_is_bucketed_and_only_the_batch_is_shuffled(spark, tmp_path):
    from pyspark.sql import functions as F

    index = DigestIndex(spark, str(tmp_path / "index"))
    rows = spark.range(100).select(text_digest(F.col("id").cast("string")).alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("place"))
    index.add(rows, 1)
    fresh = rows.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().sparkPlan().toString() + fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "SelectedBucketsCount" in plan
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = "doc_id, keep_id, group_size, kept, text_sha256"
    want = sorted(con.execute(f"SELECT {cols} FROM ({DEDUP_SQL})").fetchall())
    assert sorted(tuple(r) for r in op11_exact_dedup(spark, SF).select(*cols.split(", ")).collect()) == want
