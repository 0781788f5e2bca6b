"""Choosing the sites to evaluate, and dealing them to batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import to_fractional
from .ranges import numbered


def filter_cell_box(df: DataFrame, low: Sequence[float | None] | None, high: Sequence[float | None] | None, cells: Sequence[str] = ("cell_x", "cell_y", "cell_z")) -> DataFrame:
    """Inclusive box of cell numbers. Missing limits or columns leave the table as it is; a missing axis is not bounded."""
    if low is None or high is None or any(c not in df.columns for c in cells[: len(low)]):
        return df
    for c, a, b in zip(cells, low, high, strict=False):
        if a is not None:
            df = df.where(F.col(c) >= a)
        if b is not None:
            df = df.where(F.col(c) <= b)
    return df


def expand_rules(rules: DataFrame) -> DataFrame:
    """Rules (``rule_no, element, refnumbers, dist, step``) with one row for each reference number; incomplete rules are left out."""
    full = rules.dropna(subset=["rule_no", "element", "refnumbers", "dist", "step"])
    return full.withColumn("refnumber", F.explode("refnumbers")).drop("refnumbers")


def select_sites(atoms: DataFrame, rules: DataFrame) -> DataFrame:
    """Atoms that a rule names by element and reference number, with its ``dist`` and ``step``; the first rule wins."""
    return first_wins(atoms.join(rules, ["element", "refnumber"]), "site_id", "rule_no")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one of the lowest order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def append_unseen(new: DataFrame, old: DataFrame, key: str = "site_id") -> DataFrame:
    """Old rows, and new ones whose key is not among them."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(old.columns))


def _with_total(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return numbered(df, order, total="_total")


def batch_even(df: DataFrame, n: int, order: Sequence[str], offset: int = 0) -> DataFrame:
    """``n`` batches; the first (total mod n) get one row more. Numbers go on after ``offset``."""
    size, extra = F.floor(F.col("_total") / n), F.col("_total") % n
    big = extra * (size + 1)
    no = F.when(F.col("row_no") < big, F.floor(F.col("row_no") / (size + 1))).otherwise(extra + F.floor((F.col("row_no") - big) / F.greatest(size, F.lit(1))))
    return _with_total(df, order).withColumn("chunk_id", (no + offset).cast("int")).drop("_total")


def batch_floor(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Batches of max(1, total // n) rows; there may be more than n."""
    size = F.greatest(F.lit(1), F.floor(F.col("_total") / n))
    return _with_total(df, order).withColumn("chunk_id", F.floor(F.col("row_no") / size).cast("int")).drop("_total")


def batch_ceil(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Batches of max(1, ceil(total / n)) rows."""
    size = F.greatest(F.lit(1), F.ceil(F.col("_total") / n))
    return _with_total(df, order).withColumn("chunk_id", F.floor(F.col("row_no") / size).cast("int")).drop("_total")


def sites_from_points(points: DataFrame, vectors: Sequence[Sequence[float]], axes: Sequence[str], dist: Sequence[float], step: Sequence[float], batches: int, per_file: bool, order: Sequence[str]) -> DataFrame:
    """Sites from listed points: fractional coordinates, ids and batches.

    ``per_file`` numbers and batches each file by itself (central points, ``batch_floor``); else ids run through and batches
    are ``batch_ceil`` (full list, without patches around the points).
    """
    put = to_fractional(points, vectors, axes).withColumns({"dist": F.array(*map(F.lit, dist)), "step": F.array(*map(F.lit, step))})
    if not per_file:
        return batch_ceil(put, batches, order).withColumnRenamed("row_no", "site_id")
    out = numbered(put, order, "site_id", by=["file"], total="_total")
    return out.withColumn("chunk_id", F.floor(F.col("site_id") / F.greatest(F.lit(1), F.floor(F.col("_total") / batches))).cast("int")).drop("_total")


#: Ways of choosing sites; a user may add one.
SITE_METHODS = {"from_average": select_sites, "central": sites_from_points, "full_list": sites_from_points}
