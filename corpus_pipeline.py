"""A corpus pipeline of five training-data operators, each stage written before the next reads it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, mixing, neardup, quality
from tidemark.llm.common import read_table, work_folder
from tidemark.llm.queries import tokenizer_ranks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects; null and blank texts fail the base rules."""
    judged, _ = quality.quality_rules(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))
    # the row number is drawn after the statistics, so the filter on it is not pushed below them
    placed = judged.withColumn("row", F.monotonically_increasing_id())
    return placed.where("row >= 0 and kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang becomes the language of the text."""
    found = langid.identified(docs, langid.train(docs), keep=COLUMNS)
    return found.where("not rejected").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id, one without an id last.

    A document is its doc_id and its text, so rows that repeat an id with unlike texts are judged
    apart and rows without an id by their text. Of rows alike in both, that with the least lang,
    source and n_chars stays, nulls first. Null and empty texts are in no group.
    """
    text = F.when(F.col("text").isNull(), "-").otherwise(F.concat(F.lit("="), "text"))
    # 128 bits: at any number of documents no two of them share a key
    keyed = docs.select(*COLUMNS).withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))))
    groups = neardup.near_duplicates(keyed, carry=("key",)).select("doc_id", "key", "group")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    alone = groups.where("group is null").select("key").distinct()
    stay = groups.where("group is not null").groupBy("group").agg(first.alias("key")).select("key").union(alone)
    rows = keyed.join(stay, "key").groupBy("key").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("row"))
    return rows.select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, rounded to whole documents."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with their digests."""
    return bpe.encoded(docs, *tokenizer_ranks(), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: The learned rules, the language models and the similarity of whole texts are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again."""
    docs, base = read_table(spark, sf_dir, "documents"), work_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
