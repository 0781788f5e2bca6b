"""Lattices: products with cell vectors, cells from their parameters, metric and fractional coordinates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586


def _square(vectors: Sequence[Sequence[float]], dims: int) -> np.ndarray:
    m = np.atleast_2d(np.asarray(vectors, float))
    if m.shape != (dims, dims):
        raise ValueError(f"{dims} coordinates need {dims} x {dims} vectors, not {m.shape}")
    return m


def product(coords: Sequence[Column], matrix: np.ndarray) -> list[Column]:
    """Row vector times matrix, written out by axis; zero entries are left out."""
    out = []
    for j in range(matrix.shape[1]):
        terms = [c * F.lit(float(matrix[i, j])) for i, c in enumerate(coords) if matrix[i, j] != 0]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


def apply_lattice(df: DataFrame, vectors: Sequence[Sequence[float]], axes: Sequence[str]) -> DataFrame:
    """Replace fractional by Cartesian coordinates: r = f V."""
    parts = product([F.col(a) for a in axes], _square(vectors, len(axes)))
    return df.withColumns(dict(zip(axes, parts, strict=True)))


def to_fractional(df: DataFrame, vectors: Sequence[Sequence[float]], axes: Sequence[str]) -> DataFrame:
    """Coordinates times the inverse of the transposed vectors (right for orthogonal cells; kept as the results to match have it)."""
    parts = product([F.col(a) for a in axes], np.linalg.inv(_square(vectors, len(axes)).T))
    return df.withColumns(dict(zip(axes, parts, strict=True)))


def cell_origins(df: DataFrame, cells: Sequence[str], supercell: Sequence[int], vectors: Sequence[Sequence[float]], out: Sequence[str]) -> DataFrame:
    """(cell / supercell) V."""
    parts = product([F.col(c) / F.lit(float(s)) for c, s in zip(cells, supercell, strict=True)], _square(vectors, len(cells)))
    return df.withColumns(dict(zip(out, parts, strict=True)))


def cell_vectors(df: DataFrame, params: Sequence[str]) -> DataFrame:
    """Add ``v11 .. vDD`` from columns (a), (a, b, gamma) or (a, b, c, alpha, beta, gamma), angles in degrees."""
    c = [F.col(p) for p in params]
    if len(c) == 1:
        rows = [[c[0]]]
    elif len(c) == 3:
        g = F.radians(c[2])
        rows = [[c[0], F.lit(0.0)], [c[1] * F.cos(g), c[1] * F.sin(g)]]
    elif len(c) == 6:
        al, be, ga = (F.radians(x) for x in c[3:])
        cx = c[2] * F.cos(be)
        cy = c[2] * (F.cos(al) - F.cos(be) * F.cos(ga)) / F.sin(ga)
        zero = F.lit(0.0)
        rows = [[c[0], zero, zero], [c[1] * F.cos(ga), c[1] * F.sin(ga), zero], [cx, cy, F.sqrt(c[2] * c[2] - cx * cx - cy * cy)]]
    else:
        raise ValueError("a cell has 1, 3 or 6 parameters")
    return df.withColumns({f"v{i + 1}{j + 1}": x for i, row in enumerate(rows) for j, x in enumerate(row)})


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def cell_metric(df: DataFrame, dims: int) -> DataFrame:
    """Add ``size`` (length, area or volume) and the reciprocal vectors ``r11 .. rDD`` from ``v11 .. vDD``.

    In three dimensions the columns of V are the axes, as the results to match have it; zero volume is an error.
    """
    v = [[F.col(f"v{i + 1}{j + 1}") for j in range(dims)] for i in range(dims)]
    if dims == 1:
        size, rows = v[0][0], [[F.lit(1.0)]]
    elif dims == 2:
        size = v[0][0] * v[1][1] - v[0][1] * v[1][0]
        rows = [[v[1][1], -v[1][0]], [-v[0][1], v[0][0]]]
    else:
        a, b, c = ([v[i][j] for i in range(3)] for j in range(3))
        rows = [_cross(b, c), _cross(c, a), _cross(a, b)]
        size = sum((x * y for x, y in zip(a[1:], rows[0][1:], strict=True)), a[0] * rows[0][0])
        size = F.when(size == 0, F.raise_error(F.lit("the cell has no volume")).cast("double")).otherwise(size)
    return df.withColumns({"size": size, **{f"r{i + 1}{j + 1}": F.lit(TWO_PI) * x / size for i, row in enumerate(rows) for j, x in enumerate(row)}})


def q_of(hkl: Sequence[Column], vectors: Sequence[Sequence[float]], supercell: Sequence[int], strict: bool = False) -> list[Column]:
    """q = 2 pi (h k l) inv(V / S); with ``strict`` the inverse is transposed, which oblique cells need."""
    m = np.linalg.inv(_square(vectors, len(hkl)) / np.asarray(supercell, float))
    return [F.lit(TWO_PI) * x for x in product(list(hkl), m.T if strict else m)]


def q_to_hkl(q: Column, cell: float, size: int) -> Column:
    return F.lit(cell) * q / F.lit(size * TWO_PI)


def minimum_image(true: Sequence[Column], average: Sequence[Column], vectors: Sequence[Sequence[float]]) -> list[Column]:
    """Displacement from the average to the true position: fractional difference less its nearest integer, back to Cartesian."""
    m = _square(vectors, len(true))
    inv = np.linalg.inv(m)
    d = [a - b for a, b in zip(product(list(true), inv), product(list(average), inv), strict=True)]
    return product([x - F.rint(x) for x in d], m)
