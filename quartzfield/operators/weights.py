"""Scattering weights of atoms: elements, coefficients, form factors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .ranges import numbered


def normalize_element(name: Column) -> Column:
    return F.lower(F.trim(name))


def strip_element(name: Column) -> Column:
    return F.regexp_replace(normalize_element(name), "[^a-z0-9]", "")


def lookup_element(df: DataFrame, elements: DataFrame, value: str, out: str, fallback: float | None = None) -> DataFrame:
    """Add the value of each row's element from a table (``element``, lower case): by its trimmed lower-case name, else without
    its other characters. An unknown element is an error, unless there is a fallback."""
    one = elements.select(F.col("element").alias("_e1"), F.col(value).alias("_v1"))
    two = elements.select(F.col("element").alias("_e2"), F.col(value).alias("_v2"))
    known = F.coalesce("_v1", "_v2")
    missing = F.raise_error(F.concat(F.lit("unknown element: "), F.coalesce(F.col("element"), F.lit("null")))).cast("double") if fallback is None else F.lit(fallback)
    return (
        df.join(one, normalize_element(F.col("element")) == F.col("_e1"), "left")
        .join(two, strip_element(F.col("element")) == F.col("_e2"), "left")
        .withColumn(out, F.when(known.isNotNull(), known).otherwise(missing))
        .drop("_e1", "_v1", "_e2", "_v2")
    )


def assign_coefficients(df: DataFrame, scheme: str, elements: DataFrame | None = None, column: str = "coeff", out: str = "coeff") -> DataFrame:
    """``ones``, ``atomic_number`` (z), ``neutron`` (b) or ``config`` (a column of the table); unknown elements are an error."""
    if scheme == "ones":
        return df.withColumn(out, F.lit(1.0))
    if scheme == "config":
        return df.withColumn(out, F.col(column).cast("double"))
    if scheme in ("atomic_number", "neutron"):
        return lookup_element(df, elements, "z" if scheme == "atomic_number" else "b", out)
    raise ValueError(f"unknown coefficient scheme {scheme}")


def coefficients_by_position(atoms: DataFrame, values: DataFrame, order: str = "site_id") -> DataFrame:
    """Join listed values (``row_no, value``) to atoms by their place in ``order``; one value alone is for all. Fewer or more values than atoms are an error."""
    count = values.agg(F.count(F.lit(1)).alias("_n"), F.first("value").alias("_one"))
    placed = numbered(atoms, [order], total="_atoms").crossJoin(F.broadcast(count)).join(values, "row_no", "left")
    wrong = F.raise_error(F.concat(F.lit("coefficients: "), F.col("_n").cast("string"), F.lit(", atoms: "), F.col("_atoms").cast("string"))).cast("double")
    value = F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_n") != F.col("_atoms"), wrong).otherwise(F.coalesce("value", wrong))
    return placed.withColumn("coeff", value).drop("_n", "_one", "_atoms", "value", "row_no")


def map_matrix(atoms: DataFrame, matrix: DataFrame, nx: int, ny: int, by_x: bool = False) -> DataFrame:
    """Coefficient of the matrix cell (``i, j, value``) that an atom's cell lies in; rows are y unless ``by_x``."""

    def index(f: str, n: int) -> Column:
        return F.least(F.greatest(F.rint(F.col(f) * float(n)), F.lit(0.0)), F.lit(n - 1.0)).cast("int")

    ix, iy = index("xav", nx), index("yav", ny)
    placed = atoms.withColumns({"_i": ix if by_x else iy, "_j": iy if by_x else ix})
    return placed.join(matrix.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias("matrix_value")), ["_i", "_j"]).drop("_i", "_j")


def center_coefficients(df: DataFrame, mode: str | None, coeff: str = "coeff") -> DataFrame:
    """Subtract the global mean or that of the reference number; a table without reference numbers uses the global one."""
    names = {"none": None, "global": (), "mean": (), "avg": (), "refnumber": ("refnumber",), "refnumbers": ("refnumber",), "site": ("refnumber",), "sites": ("refnumber",)}
    if mode is None:
        return df
    if mode not in names:
        raise ValueError(f"unknown centring {mode}")
    by = names[mode]
    if by is None:
        return df
    if by and by[0] in df.columns:
        # means by a join with few rows, so that no task needs all atoms of a reference number
        means = df.groupBy(*by).agg(F.avg(coeff).alias("_mean"))
        return df.join(means, list(by)).withColumn(coeff, F.col(coeff) - F.col("_mean")).drop("_mean")
    return df.crossJoin(F.broadcast(df.agg(F.avg(coeff).alias("_mean")))).withColumn(coeff, F.col(coeff) - F.col("_mean")).drop("_mean")


def form_factor_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters ``a, b, c`` of (lower-case element, charge), else those of charge 0, else an error."""
    own = params.select(F.col("element").alias("_e"), F.col("charge").alias("_q"), F.struct("a", "b", "c").alias("_own"))
    zero = params.where("charge = 0").select(F.col("element").alias("_e0"), F.struct("a", "b", "c").alias("_zero"))
    key = F.lower("element")
    found = df.join(own, (key == F.col("_e")) & (F.col("charge") == F.col("_q")), "left").join(zero, key == F.col("_e0"), "left")
    best = F.coalesce("_own", "_zero")
    checked = F.when(best.isNull(), F.raise_error(F.concat(F.lit("no form factor for "), F.col("element"))).cast("int")).otherwise(0)
    return found.withColumns({"a": best["a"], "b": best["b"], "c": best["c"] + checked}).drop("_e", "_q", "_own", "_e0", "_zero")


#: Weights of an element at g by kind; a user may add one. Each takes (g, a, b, c).
FORM_FACTORS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "doyle_turner": scalars.doyle_turner,
    "peng": lambda g, a, b, c: scalars.peng(g, a, b),
    "lobato": lambda g, a, b, c: scalars.lobato(g, a, b),
    "default": lambda g, a, b, c: F.lit(1.0),
}


def attach_weights(atoms: DataFrame, weights: DataFrame, value: str, out: str = "weight", fallback: float | None = None) -> DataFrame:
    """Element weights by a join: ``fallback`` None makes an unknown element an error; neutron lengths use 10.0."""
    return lookup_element(atoms, weights, value, out, fallback)


def attach_average(atoms: DataFrame, average: DataFrame, key: str = "site_id", axes: Sequence[str] = "xyz") -> DataFrame:
    """Average positions and elements from another structure; both must hold the same atoms, else it is an error."""
    names = [f"{a}av" for a in axes]
    other = average.select(F.col(key).alias("_key"), F.col("element").alias("_element"), *(F.col(a).alias(n) for a, n in zip(axes, names, strict=True)))
    both = atoms.drop("element", *names).join(other, F.col(key) == F.col("_key"), "full")
    same = F.when(F.col(key).isNull() | F.col("_key").isNull(), F.raise_error(F.lit("the structures hold different atoms")).cast("string")).otherwise(F.col("_element"))
    return both.withColumn("element", same).drop("_key", "_element")


def average_structure(atoms: DataFrame, supercell: Sequence[int], axes: Sequence[str] = "xyz") -> DataFrame:
    """Average position in the cell of each (element, reference number), put into each atom's cell and wrapped into the box."""
    offsets, cells = {}, {}
    for a, s in zip(axes, supercell, strict=True):
        cells[a] = F.col(f"cell_{a}") / float(s)
        d = F.col(a) - cells[a]
        offsets[f"_d{a}"] = F.when(d < -0.5, d + 1.0).when(d > 0.5, d - 1.0).otherwise(d)
    moved = atoms.withColumns(offsets)
    means = moved.groupBy("element", "refnumber").agg(*(F.avg(f"_d{a}").alias(f"_m{a}") for a in axes))
    out = moved.join(means, ["element", "refnumber"])
    for a in axes:
        p = cells[a] + F.col(f"_m{a}")
        out = out.withColumn(f"{a}av", F.when(p < 0, p + 1.0).when(p > 1, p - 1.0).otherwise(p))
    return out.drop(*offsets, *(f"_m{a}" for a in axes))


