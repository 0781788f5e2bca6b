"""Inverse transform of masked amplitudes onto patches, its normalisation, and what has been added up already."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complexcols as C
from .arrays import spread
from .scattering import phase, tiles


def residual_field(ampl: DataFrame, points: DataFrame, q_axes: Sequence[str], p_axes: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``key, d_re, d_im, av_re, av_im`` of each patch point: sums of (A - Aav) exp(-i q p) and of Aav exp(-i q p)."""
    back = C.conjugate(C.unit(phase(q_axes, p_axes)))
    diff = C.multiply((F.col("a_re") - F.col("av_re"), F.col("a_im") - F.col("av_im")), back)
    mean = C.multiply((F.col("av_re"), F.col("av_im")), back)
    pairs = points.crossJoin(ampl)
    return pairs.groupBy(*key).agg(F.sum(diff[0]).alias("d_re"), F.sum(diff[1]).alias("d_im"), F.sum(mean[0]).alias("av_re"), F.sum(mean[1]).alias("av_im"))


def residual_field_tiled(ampl: DataFrame, points: DataFrame, q_axes: Sequence[str], p_axes: Sequence[str], key: Sequence[str], q_rows: int = 2048, p_rows: int = 2048) -> DataFrame:
    """As ``residual_field``, by matrix products of tiles of amplitudes and tiles of patch points, in one, two or three dimensions.

    A task holds one pair of tiles at a time (2048 x 2048 phases, 64 MB at most), neither side is broadcast whole, and a pair of tiles leaves one
    row for each of its points instead of one for each point and reciprocal point. ``key`` are columns of ``points``.
    """
    dims, values = len(q_axes), ("a_re", "a_im", "av_re", "av_im")
    one = tiles(ampl.select(*(F.col(a).cast("double").alias(f"q{i}") for i, a in enumerate(q_axes)), *(F.col(v).cast("double").alias(v) for v in values)), [*(f"q{i}" for i in range(dims)), *values], q_rows, "_tq")
    kinds = dict(points.dtypes)
    placed = points.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), *(F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate(p_axes)))
    two = tiles(placed, [*(f"k{i}" for i in range(len(key))), *(f"p{i}" for i in range(dims))], p_rows, "_tp")
    out = ("d_re", "d_im", "av_re", "av_im")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                q = np.array([getattr(row, f"q{i}") for i in range(dims)])
                p = np.array([getattr(row, f"p{i}") for i in range(dims)]).T
                a = np.asarray(row.a_re) + 1j * np.asarray(row.a_im)
                mean = np.asarray(row.av_re) + 1j * np.asarray(row.av_im)
                sums = np.exp(-1j * (p @ q)) @ np.stack([a - mean, mean], 1)
                columns = [sums[:, 0].real, sums[:, 0].imag, sums[:, 1].real, sums[:, 1].imag]
                yield pd.DataFrame({**{f"k{i}": getattr(row, f"k{i}") for i in range(len(key))}, **dict(zip(out, columns, strict=True))})

    schema = ", ".join([*(f"k{i} {kinds[k]}" for i, k in enumerate(key)), *(f"{o} double" for o in out)])
    parts = spread(two, "_tp").crossJoin(one).mapInPandas(run, schema)
    summed = parts.groupBy(*(f"k{i}" for i in range(len(key)))).agg(*(F.sum(o).alias(o) for o in out))
    return summed.withColumnsRenamed({f"k{i}": k for i, k in enumerate(key)})


def merge_partials(parts: DataFrame, key: Sequence[str], part: Sequence[str], values: Sequence[str], refuse: bool = False) -> DataFrame:
    """Add partial sums by key. A part delivered twice counts once, or with ``refuse`` is an error."""
    if refuse:
        once = parts.groupBy(*key, *part).agg(F.count(F.lit(1)).alias("_n"), *(F.first(v).alias(v) for v in values))
        first = F.when(F.col("_n") > 1, F.raise_error(F.lit("a part was delivered twice")).cast("double"))
        once = once.withColumns({values[0]: F.coalesce(first, F.col(values[0]))})
    else:
        once = parts.dropDuplicates([*key, *part])
    return once.groupBy(*key).agg(*(F.sum(v).alias(v) for v in values))


def normalize_residual(residual: DataFrame, total: DataFrame, values: Sequence[str] = ("d_re", "d_im", "av_re", "av_im")) -> DataFrame:
    """Divide by the number of reciprocal points of all intervals before masking (``total``: one row, one column). None or <= 0 leaves the values."""
    t = F.broadcast(total.toDF("_t"))
    return residual.crossJoin(t).withColumns({v: F.when(F.col("_t") > 0, F.col(v) / F.col("_t")).otherwise(F.col(v)) for v in values}).drop("_t")


def mirror_conjugate(residual: DataFrame, count: str | None = None) -> DataFrame:
    """Add the conjugate half of the grid: real parts double, imaginary parts vanish, the count doubles."""
    out = {"d_re": F.col("d_re") * 2, "d_im": F.lit(0.0), "av_re": F.col("av_re") * 2, "av_im": F.lit(0.0)}
    return residual.withColumns(out | ({count: F.col(count) * 2} if count else {}))


def pending_pairs(intervals: DataFrame, chunks: DataFrame, applied: DataFrame) -> DataFrame:
    """(interval, chunk) pairs that have not been added up; both lists are short."""
    return intervals.select("interval_id").distinct().crossJoin(chunks.select("chunk_id").distinct()).join(applied, ["interval_id", "chunk_id"], "left_anti")


def centre_value(residual: DataFrame, sites: DataFrame, axes: Sequence[str], points: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of each site, the values at its centre: the first point within 1e-10 on all axes, else the nearest, the first on ties.

    Sites without points give no row. The choice is a minimum by site, so partial minima are taken before the shuffle.
    """
    gaps = [F.abs(F.col(p) - F.col(a)) for a, p in zip(axes, points, strict=True)]
    within = gaps[0] <= 1e-10
    for g in gaps[1:]:
        within = within & (g <= 1e-10)
    square = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    order = F.struct(F.when(within, 0).otherwise(1), F.when(within, 0.0).otherwise(F.sqrt(square)), F.col("point_no"))
    joined = residual.join(sites.select("site_id", *axes), "site_id")
    best = joined.groupBy("site_id").agg(F.min_by(F.struct(*values), order).alias("_v"))
    return best.select("site_id", *(F.col(f"_v.{v}").alias(v) for v in values))


def pick_centre(residual: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first row of each site in the given order."""
    n = F.row_number().over(Window.partitionBy("site_id").orderBy(*order))
    return residual.withColumn("_n", n).where("_n = 1").drop("_n")


def attach_site_attributes(result: DataFrame, atoms: DataFrame) -> DataFrame:
    """Element and reference number onto results."""
    return result.join(atoms.select("site_id", "element", "refnumber"), "site_id", "left")
