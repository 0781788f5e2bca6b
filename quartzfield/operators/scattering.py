"""Forward transform: amplitudes of atoms on reciprocal points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexcols as C
from .arrays import spread

TWO_PI = 6.283185307179586


def phase(q: Sequence[str], r: Sequence[str]) -> Column:
    terms = [F.col(a) * F.col(b) for a, b in zip(q, r, strict=True)]
    return sum(terms[1:], terms[0])


def amplitudes(atoms: DataFrame, q: DataFrame, q_axes: Sequence[str], axes: Sequence[str], origins: Sequence[str], key: Sequence[str], coeff: str = "coeff") -> DataFrame:
    """``key, a_re, a_im, av_re, av_im``: A = sum c exp(i q r) and Aav = sum exp(i q R) sum c exp(i q (r - R)) / N.

    Columns only: every atom meets every point once, all six sums come from one pass, and partial sums leave each task as one row a
    point. Spark broadcasts the smaller side where its size allows. For many pairs use ``amplitudes_tiled``.
    """
    pairs = atoms.crossJoin(q)
    full, origin = C.unit(phase(q_axes, axes)), C.unit(phase(q_axes, origins))
    delta = C.multiply(full, C.conjugate(origin))
    c = F.col(coeff)
    names = {"_a_re": c * full[0], "_a_im": c * full[1], "_o_re": origin[0], "_o_im": origin[1], "_d_re": c * delta[0], "_d_im": c * delta[1]}
    sums = pairs.groupBy(*key).agg(*(F.sum(x).alias(n) for n, x in names.items()), F.count(F.lit(1)).alias("_n"))
    return _average(sums, key)


def _average(sums: DataFrame, key: Sequence[str]) -> DataFrame:
    av = C.multiply((F.col("_o_re"), F.col("_o_im")), (F.col("_d_re"), F.col("_d_im")))
    return sums.select(*key, F.col("_a_re").alias("a_re"), F.col("_a_im").alias("a_im"), (av[0] / F.col("_n")).alias("av_re"), (av[1] / F.col("_n")).alias("av_im"))


def tiles(df: DataFrame, columns: Sequence[str], rows: int, name: str) -> DataFrame:
    """Rows gathered into tiles of about ``rows``: an array for each column. Tiles are dealt by hash, so none grows with the table."""
    count = df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.lit(1)).alias("_tiles"))
    dealt = df.crossJoin(F.broadcast(count)).withColumn(name, F.pmod(F.xxhash64(*columns), F.col("_tiles")))
    return dealt.groupBy(name).agg(*(F.collect_list(F.col(c)).alias(c) for c in columns))


def amplitudes_tiled(atoms: DataFrame, q: DataFrame, q_axes: Sequence[str], axes: Sequence[str], origins: Sequence[str], key: str, coeff: str = "coeff", atom_rows: int = 4096, q_rows: int = 2048) -> DataFrame:
    """As ``amplitudes``, by matrix products of tiles of atoms and tiles of points; partial sums meet by point.

    A task holds one pair of tiles at a time (4096 x 2048 phases, 64 MB at most for each part), neither side is
    broadcast whole, and the number of pairs of tiles sets the parallelism. ``key`` is an integer column of ``q``.
    """
    one = tiles(atoms.select(*[F.col(a).cast("double").alias(f"r{i}") for i, a in enumerate(axes)], *[F.col(a).cast("double").alias(f"o{i}") for i, a in enumerate(origins)], F.col(coeff).cast("double").alias("c")), [*(f"r{i}" for i in range(len(axes))), *(f"o{i}" for i in range(len(axes))), "c"], atom_rows, "_ta")
    two = tiles(q.select(F.col(key).cast("bigint").alias("key"), *[F.col(a).cast("double").alias(f"q{i}") for i, a in enumerate(q_axes)]), ["key", *(f"q{i}" for i in range(len(axes)))], q_rows, "_tq")
    dims = len(axes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                r = np.array([getattr(row, f"r{i}") for i in range(dims)])
                o = np.array([getattr(row, f"o{i}") for i in range(dims)])
                points = np.array([getattr(row, f"q{i}") for i in range(dims)]).T
                c = np.asarray(row.c)
                full, origin = np.exp(1j * (points @ r)), np.exp(1j * (points @ o))
                a, s, d = full @ c, origin.sum(1), (full * origin.conj()) @ c
                yield pd.DataFrame({"key": row.key, "_a_re": a.real, "_a_im": a.imag, "_o_re": s.real, "_o_im": s.imag, "_d_re": d.real, "_d_im": d.imag, "_n": len(c)})

    # the tiles of points are the streamed side; each is a row of a few kB
    pairs = spread(two, "_tq").crossJoin(one)
    parts = pairs.mapInPandas(run, "key bigint, _a_re double, _a_im double, _o_re double, _o_im double, _d_re double, _d_im double, _n bigint")
    sums = parts.groupBy("key").agg(*(F.sum(x).alias(x) for x in ("_a_re", "_a_im", "_o_re", "_o_im", "_d_re", "_d_im", "_n")))
    return _average(sums, ["key"]).withColumnRenamed("key", key)


def amplitudes_by_element(atoms: DataFrame, q: DataFrame, q_axes: Sequence[str], axes: Sequence[str], origins: Sequence[str], key: Sequence[str], weight: Column) -> DataFrame:
    """Sums by element, each with its form factor ``weight`` (over columns of ``q`` and ``element``): f S and f Sav Sdelta / N with N all atoms."""
    full, origin = C.unit(phase(q_axes, axes)), C.unit(phase(q_axes, origins))
    delta = C.multiply(full, C.conjugate(origin))
    names = {"_a_re": full[0], "_a_im": full[1], "_o_re": origin[0], "_o_im": origin[1], "_d_re": delta[0], "_d_im": delta[1]}
    sums = atoms.crossJoin(q).groupBy(*key, "element").agg(*(F.sum(x).alias(n) for n, x in names.items()), F.first(weight).alias("_f"), F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(atoms.agg(F.count(F.lit(1)).alias("_all")))
    av = C.multiply((F.col("_o_re"), F.col("_o_im")), (F.col("_d_re"), F.col("_d_im")))
    f = F.col("_f")
    each = {"a_re": f * F.col("_a_re"), "a_im": f * F.col("_a_im"), "av_re": f * av[0] / F.col("_all"), "av_im": f * av[1] / F.col("_all")}
    return sums.crossJoin(total).groupBy(*key).agg(*(F.sum(x).alias(n) for n, x in each.items()))


def intensity() -> list[Column]:
    """Total and diffuse intensity of amplitudes."""
    a, av = (F.col("a_re"), F.col("a_im")), (F.col("av_re"), F.col("av_im"))
    return [C.abs2(a).alias("total"), C.abs2((a[0] - av[0], a[1] - av[1])).alias("diffuse")]
