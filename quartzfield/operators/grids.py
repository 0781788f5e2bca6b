"""Reciprocal intervals, q grids and patch grids. Grid points are integers: h = ih / S."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "hkl"


def _ranges(limit: Column, step: Column, size: Column, symmetric: bool, plane: bool = False) -> Column:
    """Array of (no, start, end) of one axis: negative parts outwards, then positive ones; ends are cut at the limit."""
    last = F.ceil(limit / step).cast("int") - 1
    grid = F.lit(1.0) / size

    def part(no: Column, start: Column, end: Column) -> Column:
        return F.struct(no.cast("int").alias("no"), start.alias("start"), end.alias("end"))

    def positive(i: Column) -> Column:
        first = grid if not symmetric else F.lit(0.0)
        return part(i, F.when(i == 0, first).otherwise(i * step + grid), F.least((i + 1) * step, limit))

    up = F.transform(F.sequence(F.lit(0), last), positive)
    if not symmetric:
        return up
    down = F.transform(F.sequence(F.lit(0), last), lambda i: part(-i - 1, -F.least((i + 1) * step, limit), -(i * step + grid)))
    return F.concat(down, up)


def make_intervals(specs: DataFrame, dims: int, previous: Sequence[str] | None = None) -> DataFrame:
    """Intervals of each row of ``specs`` (``spec_id``, ``h_limit, h_step, h_size`` and so on by axis).

    h and k are symmetric; l is positive, with the plane l = 0 apart. With ``previous`` (columns of the limits reached before) only
    combinations with at least one new range come, the plane only for new h or k: those that an extension adds.

    Each range but the first begins one grid spacing behind the end of the one before. With a step that is no multiple of the spacing 1 / size, and always with a
    smaller one, grid points between two ranges are in neither: that is the rule that results are matched to, so choose steps of whole spacings.
    """
    old = [F.col(p) for p in previous] if previous else [F.lit(0.0)] * dims
    out = specs
    for i, a in enumerate(AXES[:dims]):
        ranges = _ranges(F.col(f"{a}_limit"), F.col(f"{a}_step"), F.col(f"{a}_size"), a != "l")
        if a == "l":
            zero = F.struct(F.lit(-1).alias("no"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
            ranges = F.concat(ranges, F.array(zero))
        out = out.withColumn(f"_{a}", F.explode(ranges)).withColumn(f"_new_{a}", F.abs(F.col(f"_{a}.end")) > old[i])
    fresh = F.col("_new_h") | F.col("_new_k") if dims > 1 else F.col("_new_h")
    if dims == 3:
        fresh = F.when(F.col("_l.no") < 0, fresh).otherwise(fresh | F.col("_new_l"))
    ends = [F.col(f"_{a}.{end}").alias(f"{a}_{end}") for a in AXES[:dims] for end in ("start", "end")]
    return out.where(fresh).select("spec_id", *ends)


def extend_intervals(new: DataFrame, old: DataFrame, dims: int, places: int = 6) -> DataFrame:
    """Old intervals and those new ones that are not among them; ends are compared to ``places`` decimals."""
    keys = ["spec_id", *(f"{a}_{e}" for a in AXES[:dims] for e in ("start", "end"))]
    one = [F.col("spec_id"), *(F.round(k, places).alias(k) for k in keys[1:])]
    return old.select(*one).unionByName(new.select(*one)).dropDuplicates(keys)


def _index(x: Column, size: Column) -> Column:
    """Grid index without the last bits of the division, which would cut off a plane at an interval's end."""
    return F.round(x * size, 6)


def _points(start: Column, end: Column, size: Column) -> Column:
    return F.sequence(F.ceil(_index(start, size)).cast("int"), F.floor(_index(end, size)).cast("int"))


def _filled(start: Column, end: Column, size: Column) -> Column:
    return F.floor(_index(end, size)) >= F.ceil(_index(start, size))


def q_grid(intervals: DataFrame, sizes: Sequence[Column | int], mask: Column | None = None) -> DataFrame:
    """Explode intervals into points ``ih, ik, il`` with ``h, k, l``; absent axes are 0. The mask filters before anything is computed."""
    out = intervals
    for i, a in enumerate(AXES):
        if i < len(sizes):
            size = sizes[i] if isinstance(sizes[i], Column) else F.lit(float(sizes[i]))
            start, end = F.col(f"{a}_start"), F.col(f"{a}_end")
            out = out.where(_filled(start, end, size)).withColumn(f"i{a}", F.explode(_points(start, end, size))).withColumn(a, F.col(f"i{a}") / size)
        else:
            out = out.withColumns({f"i{a}": F.lit(0), a: F.lit(0.0)})
    return out if mask is None else out.where(mask)


def axis_bounds(intervals: DataFrame, sizes: Sequence[Column | int], axes: Sequence[str]) -> DataFrame:
    """Least and largest h, k, l of the grid of some intervals (``h_low, h_high`` and so on; one row), without making its points."""
    out, bounds = intervals, []
    for a, s in zip(AXES, sizes, strict=False):
        size = s if isinstance(s, Column) else F.lit(float(s))
        start, end = F.col(f"{a}_start"), F.col(f"{a}_end")
        out = out.where(_filled(start, end, size))
        if a in axes:
            bounds += [F.min(F.ceil(_index(start, size)) / size).alias(f"{a}_low"), F.max(F.floor(_index(end, size)) / size).alias(f"{a}_high")]
    return out.agg(*bounds)


def count_reciprocal_points(sizes: Sequence[Column | int]) -> Column:
    """Points of an interval; twice as many in three dimensions unless it is the plane l = 0, as the other half is not stored."""
    total = F.lit(1).cast("bigint")
    for a, s in zip(AXES, sizes, strict=False):
        size = s if isinstance(s, Column) else F.lit(float(s))
        total = total * (F.floor((F.col(f"{a}_end") - F.col(f"{a}_start")) * size + 0.5) + 1)
    if len(sizes) == 3:
        total = total * F.when((F.col("l_start") == 0) & (F.col("l_end") == 0), 1).otherwise(2)
    return total


def accepted_count(q: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points kept in each interval, doubled where the interval leaves l = 0."""
    return q.groupBy(*by).agg((F.count(F.lit(1)) * F.when(F.max(F.abs("l")) > 1e-7, 2).otherwise(1)).alias("accepted"))


def hkl_max(intervals: DataFrame, dims: int) -> DataFrame:
    return intervals.agg(*(F.max(F.greatest(F.abs(f"{a}_start"), F.abs(f"{a}_end"))).alias(f"{a}_max") for a in AXES[:dims]))


def axis_size(dist: Column, step: Column) -> Column:
    """Patch points along one axis: 1 if there is no room for a step, else -dist, -dist + step, ... below dist + step - 1e-8."""
    return F.when((step <= 0) | (dist <= step), 1).otherwise(F.ceil((2.0 * dist + step - 1e-8) / step)).cast("int")


def patch_grid(sites: DataFrame, axes: Sequence[str], dist: str = "dist", step: str = "step") -> DataFrame:
    """Points around each site (``dist`` and ``step`` arrays by axis): ``point_no`` in C order and ``p<axis>``."""
    out, number = sites, F.lit(0).cast("bigint")
    for i, a in enumerate(axes):
        d, s = F.col(dist)[i], F.col(step)[i]
        n = axis_size(d, s)
        out = out.withColumn(f"_i{i}", F.explode(F.sequence(F.lit(0), n - 1)))
        number = number * n + F.col(f"_i{i}")
        out = out.withColumn(f"p{a}", F.col(a) + F.when(n == 1, F.when((s <= 0) | (d <= s), 0.0).otherwise(-d)).otherwise(-d + F.col(f"_i{i}") * s))
    return out.withColumn("point_no", number).drop(*(f"_i{i}" for i in range(len(axes))))


def patch_size(dims: int, dist: str = "dist", step: str = "step") -> Column:
    """floor((2 dist + step - 1e-8) / step) + 1 points by axis, multiplied; 1 for an axis without a step."""
    total = F.lit(1).cast("bigint")
    for i in range(dims):
        d, s = F.col(dist)[i], F.col(step)[i]
        total = total * F.when(s <= 0, 1).otherwise(F.floor((2.0 * d + s - 1e-8) / s) + 1)
    return total
