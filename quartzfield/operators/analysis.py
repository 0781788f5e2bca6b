"""Published analyses of site results: coordination, statistics, smoothing, domains, additivity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .halo import periodic_neighbours, smoothed
from .ranges import exact_percentiles, numbered


def distinct_elements(atoms: DataFrame) -> DataFrame:
    """Each element with its number of atoms and its reference numbers."""
    return atoms.groupBy("element").agg(F.count(F.lit(1)).alias("atoms"), F.sort_array(F.collect_set("refnumber")).alias("refnumbers"))


def rms(re: Column, im: Column) -> Column:
    return F.sqrt(F.avg(re * re + im * im))


def site_grid(df: DataFrame, axes: Sequence[str], cell: Sequence[float], size: Sequence[int], out: Sequence[str]) -> DataFrame:
    """Cells of a half-cell lattice: rint(2 x / a) mod n."""
    return df.withColumns({o: F.pmod(F.rint(F.col(a) * 2.0 / float(c)), F.lit(float(n))).cast("int") for a, c, n, o in zip(axes, cell, size, out, strict=True)})


#: Six nearest neighbours of a simple cubic lattice, four of a square one.
SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def coordination_histogram(pairs: DataFrame, centre: str, kind: str, neighbour_kind: str, wanted: str) -> DataFrame:
    """How many neighbours of kind ``wanted`` the centres of each kind have: count and percent."""
    each = pairs.groupBy(centre, kind).agg(F.sum(F.when(F.col(neighbour_kind) == wanted, 1).otherwise(0)).alias("split"))
    counts = each.groupBy(kind, "split").agg(F.count(F.lit(1)).alias("centres"))
    totals = counts.groupBy(kind).agg(F.sum("centres").alias("_all"))
    return counts.join(totals, kind).select(kind, "split", "centres", (100.0 * F.col("centres") / F.col("_all")).alias("percent"))


def stats_by_element(df: DataFrame, value: str, element: str = "element", sign: Column | None = None) -> DataFrame:
    """n, mean, population deviation, shares above and below 0, and with the true ``sign`` the share that has it."""
    v = F.col(value)
    parts = [F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("above"), F.avg(F.when(v < 0, 1.0).otherwise(0.0)).alias("below")]
    if sign is not None:
        parts.append(F.avg(F.when(F.signum(v) == sign, 1.0).otherwise(0.0)).alias("accuracy"))
    return df.groupBy(element).agg(*parts)


def sign_coordination(pairs: DataFrame, centre: str, value: str, true: str, neighbours: int = 6) -> DataFrame:
    """Positive and negative neighbours of each centre that has all of them, next to the true numbers."""
    v, t = F.col(value), F.col(true)

    def count(x: Column) -> Column:
        return F.sum(F.when(x, 1).otherwise(0))

    return pairs.groupBy(centre).agg(count(v > 0).alias("positive"), count(v < 0).alias("negative"), count(t > 0).alias("true_positive"), count(t < 0).alias("true_negative"), F.count(v).alias("_known")).where(F.col("_known") == neighbours).drop("_known")


def mean_by_coordination(pairs: DataFrame, centre: str, value: str, split: Column) -> DataFrame:
    """Mean of the known neighbours of each centre, then mean and deviation by the centre's true split."""
    each = pairs.groupBy(centre).agg(F.avg(value).alias("_m"), F.sum(split).alias("split")).where("_m IS NOT NULL")
    return each.groupBy("split").agg(F.count(F.lit(1)).alias("centres"), F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("std"))


def intensity_percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float] = (0.01, 0.995)) -> DataFrame:
    """``by, p0, p1, ...``: exact interpolated percentiles of the positive values; a group without any gives no row."""
    return exact_percentiles(df.where(F.col(value) > 0), by, value, shares)


def intensity_map(df: DataFrame, value: str, order: str) -> DataFrame:
    """One value for each (ih, ik); of several the last in ``order``."""
    return df.groupBy("ih", "ik").agg(F.max_by(value, order).alias(value))


def staggered_order(ix: str, iy: str, value: str) -> Column:
    return F.when(F.pmod(F.col(ix) + F.col(iy), F.lit(2)) == 0, F.col(value)).otherwise(-F.col(value))


def gaussian(sigma: float, cut: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian cut at ``cut`` deviations, with sum 1."""
    reach = int(cut * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    return [(i - reach, x / sum(w)) for i, x in enumerate(w)]


def periodic_smooth(df: DataFrame, grid: Sequence[str], size: Sequence[int], value: str, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing of a periodic lattice, one axis after the other, within blocks that know their borders."""
    return smoothed(df, grid, size, value, gaussian(sigma))


def domain_boundaries(df: DataFrame, grid: Sequence[str], size: Sequence[int], value: str) -> DataFrame:
    """Cell edges where the sign changes: each row with the next one along an axis."""
    ahead = [tuple(int(i == j) for j in range(len(grid))) for i in range(len(grid))]
    pairs = periodic_neighbours(df.select(*grid, value), grid, size, ahead, [*grid, value])
    return pairs.where(F.signum(value) != F.signum(f"n_{value}"))


def join_runs(a: DataFrame, b: DataFrame, key: str, values: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Results of two runs side by side."""
    one = a.select(key, *(F.col(v).alias(f"{names[0]}_{v}") for v in values))
    return one.join(b.select(key, *(F.col(v).alias(f"{names[1]}_{v}") for v in values)), key)


def linearity_check(parts: DataFrame, whole: DataFrame, key: str, re: str = "re", im: str = "im") -> DataFrame:
    """Root mean square of (sum over disjoint masks - all) and of all, and their ratio; ``parts`` has a row for each mask and key."""
    summed = parts.groupBy(key).agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))
    both = summed.join(whole.select(key, re, im), key)
    out = both.agg(rms(F.col("_re") - F.col(re), F.col("_im") - F.col(im)).alias("rms"), rms(F.col(re), F.col(im)).alias("rms_all"))
    return out.withColumn("relative", F.col("rms") / F.col("rms_all"))


def lattice_order(df: DataFrame, x: str, y: str) -> DataFrame:
    """Grid indices by rank of the distinct coordinates, numbered by ranges, as a disordered structure has as many of them as atoms."""
    for c, out in ((x, "gx"), (y, "gy")):
        df = df.join(numbered(df.select(c).distinct(), [c], out), c)
    return df
