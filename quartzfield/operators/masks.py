"""Reciprocal-space masks: columns where a point decides alone, semi joins where special points do."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_all() -> Column:
    return F.lit(True)


def mask_equation(predicate: str) -> Column:
    """A Spark SQL predicate over h, k, l."""
    return F.expr(predicate)


def mask_custom(df: DataFrame, rule: Callable[[DataFrame], Column]) -> DataFrame:
    return df.where(rule(df))


def coordinate_sum_above(threshold: float = 5.0) -> Callable[[DataFrame], Column]:
    """A custom mask: the sum of the coordinates exceeds a threshold."""
    return lambda df: F.col("h") + F.col("k") + F.col("l") > threshold


def mask_rod_shell(mode: str, r1: float = 0.1876, r2: float = 0.2501) -> Column:
    """Rods and shells around half-integer points; ``displacement`` keeps the rod outside the shell, ``chemical`` what is outside both."""
    u, v, w = (F.pmod(F.col(a), F.lit(1.0)) - 0.5 for a in "hkl")
    rod, shell = u * u + v * v, u * u + v * v + w * w
    if mode == "displacement":
        return (rod <= r1 * r1) & (shell >= r2 * r2)
    if mode == "chemical":
        return (rod > r1 * r1) & (shell > r2 * r2)
    raise ValueError("mode is displacement or chemical")


def circle_region(r: float = 0.198) -> Column:
    """Discs around half-integer points of the (h, k) plane."""
    u, v = (F.pmod(F.col(a), F.lit(1.0)) - 0.5 for a in "hk")
    return u * u + v * v <= r * r


def periodic_candidates(points: DataFrame, value: str, low: str, high: str, out: str = "candidate") -> DataFrame:
    """Periodic images of ``value`` between the columns ``low`` and ``high``: rows of ``points`` for each candidate.

    For n = 0 the images are -|a| and |a|, within 1 of the bounds when both lie there, else strictly inside; for other n the image
    is sign(n) (|n| + |a|). Rounded to 8 decimals, distinct for each point.
    """
    lo, hi, a = F.round(low, 8), F.round(high, 8), F.col(value)
    n = F.col("_n")
    wide = a.between(lo - 1, hi + 1) & (-a).between(lo - 1, hi + 1)
    image = F.when(n == 0, F.abs(a) * F.col("_sign")).otherwise(F.signum(n.cast("double")) * (F.abs(n) + F.abs(a)))
    keep = F.when(n == 0, F.when(wide, F.col("_c").between(lo - 1, hi + 1)).otherwise(F.col("_c").between(lo, hi))).otherwise(F.col("_c").between(lo, hi) & (F.col("_sign") == 1))
    made = points.withColumn("_n", F.explode(F.sequence(F.floor(low).cast("int") - 2, F.ceil(high).cast("int") + 1))).withColumn("_sign", F.explode(F.array(F.lit(-1), F.lit(1))))
    return made.withColumn("_c", image).where(keep).withColumn(out, F.round("_c", 8) + F.lit(0.0)).drop("_n", "_sign", "_c").distinct()


def _bounds(q: DataFrame, axes: Sequence[str], pad: float, known: DataFrame | None = None) -> DataFrame:
    """One row of padded bounds: from those of the intervals if they are known, else from the points."""
    ends = known if known is not None else q.agg(*(x for a in axes for x in (F.min(a).alias(f"{a}_low"), F.max(a).alias(f"{a}_high"))))
    return ends.select(*(x for a in axes for x in ((F.col(f"{a}_low") - pad).alias(f"_{a}_low"), (F.col(f"{a}_high") + pad).alias(f"_{a}_high"))))


def mask_periodic(q: DataFrame, points: DataFrame, axes: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    """Points of ``q`` within ``radius`` of a periodic image of a special point (``c_h, c_k, c_l, radius``).

    One axis: an interval; two: a circle, both with images up to 1 beyond the grid; three: a sphere, images inside the grid. Images and
    grid points meet in cells as wide as the largest radius and their neighbours, so the join has an equality that
    Spark can shuffle on, and no point is compared with far ones. ``bounds`` (``grids.axis_bounds`` of the intervals) spare a second pass over the grid.
    """
    pad = 0.0 if len(axes) == 3 else 1.0
    found = points.crossJoin(F.broadcast(_bounds(q, axes, pad, bounds)))
    for a in axes:
        found = periodic_candidates(found, f"c_{a}", f"_{a}_low", f"_{a}_high", f"_{a}")
    found = found.select(*(f"_{a}" for a in axes), "radius").distinct()
    width = F.broadcast(points.agg(F.greatest(F.max("radius"), F.lit(1e-9)).alias("_width")))
    near = found.crossJoin(width)
    mine = q.crossJoin(width)
    for a in axes:
        cell = F.floor(F.col(f"_{a}") / F.col("_width"))
        near = near.withColumn(f"_cell_{a}", F.explode(F.array(cell - 1, cell, cell + 1)))
        mine = mine.withColumn(f"_cell_{a}", F.floor(F.col(a) / F.col("_width")))
    near, mine = near.drop("_width").alias("near"), mine.drop("_width").alias("mine")
    same = [F.col(f"mine._cell_{a}") == F.col(f"near._cell_{a}") for a in axes]
    if len(axes) == 1:
        inside = F.abs(F.col(f"mine.{axes[0]}") - F.col(f"near._{axes[0]}")) <= F.col("near.radius")
    else:
        gaps = [F.col(f"mine.{a}") - F.col(f"near._{a}") for a in axes]
        inside = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= F.col("near.radius") * F.col("near.radius")
    condition = inside
    for s in same:
        condition = s & condition
    return mine.join(near, condition, "left_semi").select(*q.columns)


def mask_ellipsoid(q: DataFrame, bodies: DataFrame) -> DataFrame:
    """Points inside one of the ellipsoids (``c_h, c_k, c_l, axis_1..3, theta, phi``, angles in radians); not periodic."""
    d = [F.col(f"q.{a}") - F.col(f"e.c_{a}") for a in "hkl"]
    ct, st, cp, sp = F.cos("e.theta"), F.sin("e.theta"), F.cos("e.phi"), F.sin("e.phi")
    x, y, z = cp * d[0] - sp * d[1], sp * d[0] + cp * d[1], d[2]
    turned = [ct * x + st * z, y, -st * x + ct * z]
    scaled = [t / F.col(f"e.axis_{i + 1}") for i, t in enumerate(turned)]
    return q.alias("q").join(bodies.alias("e"), scaled[0] * scaled[0] + scaled[1] * scaled[1] + scaled[2] * scaled[2] <= 1.0, "left_semi")


def read_box(reflections: DataFrame, q: DataFrame) -> DataFrame:
    """Reflections within half a unit of the index ranges of the grid."""
    box = F.broadcast(_bounds(q, "hkl", 0.5))
    inside = [F.col(a).between(F.col(f"_{a}_low"), F.col(f"_{a}_high")) for a in "hkl"]
    return reflections.crossJoin(box).where(inside[0] & inside[1] & inside[2]).select(*reflections.columns)


def mask_reflections(q: DataFrame, reflections: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Points that are listed; the join is on integer indices."""
    listed = reflections.select(*(F.rint(F.col(a) * float(s)).cast("int").alias(f"i{a}") for a, s in zip("hkl", sizes, strict=True))).distinct()
    return q.join(listed, ["ih", "ik", "il"], "left_semi")


def mask_partition(masks: dict[str, Column], rest: str = "rest") -> Column:
    """Name of the first mask that holds, or of the complement of all: one pass instead of a run for each mask."""
    out = None
    for name, mask in masks.items():
        out = F.when(mask, name) if out is None else out.when(mask, name)
    return (out if out is not None else F.when(F.lit(False), rest)).otherwise(F.lit(rest))


def mask_coverage(mask: Column) -> list[Column]:
    kept = F.sum(F.when(mask, 1).otherwise(0))
    return [kept.alias("kept"), F.count(F.lit(1)).alias("points"), (100.0 * kept / F.count(F.lit(1))).alias("percent")]
