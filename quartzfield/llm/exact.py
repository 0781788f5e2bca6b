"""Exact dedup with DataFrame functions only: 128-bit content hash, byte comparison inside groups, one row of each group stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, text_of


def _rank(text_len: Column, row_id: Column, prefer_longest: bool) -> Column:
    """Larger is better: more code points first if asked for, then the smaller id; null ids come last.

    A decimal keeps the aggregation buffer of fixed width, so Spark can hash-aggregate without sorting the texts.
    """
    places = F.lit("100000000000000000000").cast("decimal(21,0)")
    order = F.coalesce(F.lit("9223372036854775807").cast("decimal(20,0)") - row_id.cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)"))
    length = text_len.cast("decimal(10,0)") if prefer_longest else F.lit(0).cast("decimal(10,0)")
    return (length * places + order).cast("decimal(38,0)")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ignore: str | None = WHITESPACE, prefer_longest: bool = False) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after every match of ``ignore`` is deleted (None: as they are); null
    counts as empty, so null, empty and white-space-only texts form one group. Of equal texts the smallest id stays,
    or with ``prefer_longest`` the one with the most code points, then the smallest id. Null ids rank last; a group
    of null ids only has a null ``keep_id`` and is kept. Rows repeated with one id are counted each and share
    the verdict of their id. An empty table gives an empty result; other columns of ``df`` are not read.

    The texts are grouped by their MD5 and the text itself, so that Spark compares the bytes of texts with one hash;
    copies collapse before the shuffle. Row verdicts come back over (MD5, SHA-256), rows of fixed width, in a join that
    AQE can split when one group is very large.
    """
    rows = _normalised(df, id_col, text_col, ignore, prefer_longest)
    groups = rows.groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("group_size"), F.max_by("_id", "_rank").alias("keep_id"))
    groups = groups.select("_h", F.sha2("_norm", 256).alias("text_sha256"), "group_size", "keep_id")
    light = rows.select("_id", "_h", F.sha2("_norm", 256).alias("text_sha256"))
    return light.join(groups, ["_h", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _normalised(df: DataFrame, id_col: str, text_col: str, ignore: str | None, prefer_longest: bool, *more: Column) -> DataFrame:
    text = text_of(text_col)
    norm = F.regexp_replace(text, f"{ignore}+", "") if ignore else text
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), norm.alias("_norm"), F.length(text).alias("_len"), *more)
    return rows.withColumn("_h", F.md5("_norm")).withColumn("_rank", _rank(F.col("_len"), F.col("_id"), prefer_longest))


def exact_winners(df: DataFrame, key: Column, id_col: str = "doc_id", text_col: str = "text", ignore: str | None = WHITESPACE, prefer_longest: bool = False) -> DataFrame:
    """``key``: of each group of equal texts (as ``exact_dedup`` has them) the key of the row that stays, by which rows that share an id are told apart."""
    rows = _normalised(df, id_col, text_col, ignore, prefer_longest, key.alias("key"))
    return rows.groupBy("_h", "_norm").agg(F.max_by("key", "_rank").alias("key")).select("key")
