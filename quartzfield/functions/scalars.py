"""Scalar functions that masks and weights use beyond Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def heaviside(x: Column, at_zero: Column | float) -> Column:
    return F.when(x < 0, 0.0).when(x == 0, F.lit(at_zero).cast("double") if not isinstance(at_zero, Column) else at_zero).otherwise(1.0)


def floor_mod(x: Column, n: Column) -> Column:
    """Remainder with the sign of ``n`` (``n`` > 0: ``pmod``)."""
    return x - n * F.floor(x / n)


def nearest_index(axis: Column, value: Column) -> Column:
    """Index from 0 of the axis value nearest to ``value``; the left one on ties."""
    gaps = F.transform(axis, lambda a: F.abs(a - value))
    return F.array_position(gaps, F.array_min(gaps)) - 1


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def reduced(q_norm: Column) -> Column:
    """g = (norm(q) / 4 pi)^2, the argument of the form factors."""
    return F.pow(q_norm / F.lit(12.566370614359172), F.lit(2.0))


def doyle_turner(g: Column, a: Column, b: Column, c: Column) -> Column:
    return _sum(a, b, lambda x, y: x * F.exp(-y * g)) + c


def peng(g: Column, a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * F.exp(-y * g))


def lobato(g: Column, a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * (2.0 + y * g) / ((1.0 + y * g) * (1.0 + y * g)))


def distinct_tol(values: Column, tol: float = 1e-10) -> Column:
    """Sorted array in which a value counts as new if it is more than ``tol`` above the last one kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.sort_array(values), start, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > tol), F.concat(kept, F.array(x))).otherwise(kept))
