"""Complex numbers as two DOUBLE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def add(a: Pair, b: Pair) -> Pair:
    return a[0] + b[0], a[1] + b[1]


def multiply(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conjugate(a: Pair) -> Pair:
    return a[0], -a[1]


def abs2(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def unit(phase: Column) -> Pair:
    """exp(i * phase)"""
    return F.cos(phase), F.sin(phase)
