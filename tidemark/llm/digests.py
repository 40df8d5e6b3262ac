"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

A row's digest is the SHA-256 of its text, lower-cased A-Z only. The index is a Parquet table of the
digests seen so far, bucketed and sorted by digest, with the row that stays of each. A batch of new
rows is reduced to one row a digest (partial sums first, so a hot text costs one row a task), left
without the digests of the index by a sort-merge anti-join, in which only the batch is shuffled, and
appended. A batch that is added again appends nothing, so a batch that broke off can be repeated.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_folder, written

#: A group with more than one in HOT_SHARE of all rows is joined by broadcast; fewer than HOT_SHARE groups can be.
HOT_SHARE = 1000
INDEX_COLUMNS = "digest binary, doc_id long, place long, batch long"


def text_digest(text: Column) -> Column:
    """SHA-256 of a text lower-cased A-Z only, as 32 bytes; null counts as empty."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(plain, 256))


class DigestIndex:
    """The digests seen so far, in a folder that driver and executors share.

    The folder is an external table of the session's catalog, so another session that names the
    same folder and number of buckets goes on with it. The number of buckets is the number of
    shuffle partitions where none is given: then neither join nor append shuffles the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX_COLUMNS}) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        """digest, doc_id, place and batch of each row that stays."""
        return self.spark.table(self.table)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Append the digests of rows(digest, doc_id, place) that the index lacks; returns what was appended.

        Of rows with one digest that with the largest doc_id is appended (a null doc_id comes last),
        of rows alike in both that with the largest place.
        """
        best = F.max(F.struct("doc_id", "place"))
        lead = rows.groupBy("digest").agg(best.alias("best")).select("digest", "best.doc_id", "best.place")
        fresh = lead.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        dealt = fresh.select("digest", "doc_id", "place", "batch").repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        return self.rows().where(F.col("batch") == batch)


def exact_duplicates(docs: DataFrame, *, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs(doc_id, text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The rows are added
    to the index in `batches` parts from the largest doc_ids down, rows without a doc_id last, so of
    equal texts the row with the largest doc_id stays; with an index that has rows already, these
    stay before any new one. group_size counts the rows of docs. Rows that repeat a doc_id and its
    text are in one group, of which exactly one row is kept; a repeated doc_id with unlike texts is
    in two groups. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")).withColumn("place", F.monotonically_increasing_id()))
    index = index or DigestIndex(spark, work_folder(spark))
    first = (index.rows().agg(F.max("batch").alias("b")).first()["b"] or 0) + 1
    seen = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = seen["low"] or 0, seen["high"] or 0
    step = (high - low) // batches + 1
    part = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / step), F.lit(batches - 1))
    for k in range(batches):
        index.add(rows.where(part == k), first + k)

    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    stays = index.rows().select("digest", F.col("doc_id").alias("keep_id"), F.col("place").alias("keep_place"), (F.col("batch") >= first).alias("new"))
    groups = written(sizes.join(stays.hint("merge"), "digest"))
    large = F.col("group_size") * HOT_SHARE > seen["n"]
    # fewer than HOT_SHARE rows by their very condition
    hot = groups.where(large)
    marked = rows.join(F.broadcast(hot), "digest", "left")
    common = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.where(~large).hint("merge"), "digest")
    found = marked.where("keep_place is not null").unionByName(common)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("new") & (F.col("place") == F.col("keep_place"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


DEDUP_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
