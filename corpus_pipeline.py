"""A training corpus from the table of documents: each stage applies one text operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfield.llm.bpe import bpe_encode
from quartzfield.llm.common import materialise, table
from quartzfield.llm.decontam import drop_leaks
from quartzfield.llm.exact import exact_winners
from quartzfield.llm.minhash import near_dedup
from quartzfield.llm.queries import PATTERN, RANK_FILE
from quartzfield.llm.toxicity import drop_toxic, fit_toxicity


def _keyed(docs: DataFrame) -> DataFrame:
    """With ``_key``, which tells rows of one id or none apart by their texts."""
    return docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))))


def _staying(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with ``_key``) whose key is among ``winners``, one for each id and text; the texts are shuffled once.

    Rows of other ids or texts whose keys are equal by chance all stay with their key: a collision keeps a row too many, it never drops one.
    """
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    first = docs.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "doc_id", text).orderBy("_key"))).where("_n = 1")
    return first.join(winners, "_key", "left_semi").drop("_key", "_n")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model calls toxic; it learns from the labels of these documents. Empty texts stay."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts that are equal but for white space: the longest, then the smallest id (none counts as the largest)."""
    keyed = _keyed(docs)
    winners = exact_winners(keyed, F.col("_key"), prefer_longest=True).select(F.col("key").alias("_key"))
    return _staying(keyed, winners).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate component (five-word shingles, similarity 0.8): the smallest id (none counts as the largest)."""
    keyed = _keyed(docs)
    ids = keyed.groupBy("_key").agg(F.first("doc_id").alias("id"))
    parts = near_dedup(keyed, id_col="_key", shingle=5, percent=80).groupBy("_key").agg(F.first("component_id").alias("component"))
    winners = parts.join(ids, "_key").groupBy("component").agg(F.min_by("_key", F.struct(F.col("id").isNull(), "id", "_key")).alias("_key"))
    return _staying(keyed, winners.select("_key")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left (little-endian uint32), whether they decode to the text, and the hash of what they decode to."""
    out = bpe_encode(docs, RANK_FILE, PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("minhash_near_dedup", near), ("decontamination", decontamination), ("byte_bpe", tokens)]

#: SQL can express neither the toxicity model nor the merges; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
