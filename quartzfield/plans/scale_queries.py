"""Registered queries of the operators for large grids and tables: transforms by axis, streams of ranges, runs that go on."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import grids, masks, separable, weights
from ..sources import structures, tables
from . import flows, views
from .queries import LISTED, AMPL1, AMPL1M, FIELD1, AMPL2, AMPL3, FOUR, SQL, TWO_PI, WITH2, WITH3, _ampl_sql, _PATCH, GRID2, disc, grid_1d, grid_2d, grid_3d, grid_3s, patches, query, r, rounded

# --- transforms that factor by axis ------------------------------------------------------------------------------------------------


@query("e3_separable_1d", f"{WITH2}, {AMPL1} SELECT ih, {FOUR} FROM ampl")
def _(spark, d):
    return rounded(separable.amplitudes_separable(views.atoms_2d(spark, d), grid_1d(spark, d), ["ih"], ["x"], ["xav"]))


@query("e4_separable_2d", f"{WITH2}, {AMPL2} SELECT ih, ik, {FOUR} FROM ampl")
def _(spark, d):
    return rounded(separable.amplitudes_separable(views.atoms_2d(spark, d), grid_2d(spark, d), ["ih", "ik"], ["x", "y"], ["xav", "yav"]))


@query("e4_separable_3d", f"{WITH3}, {AMPL3} SELECT ih, ik, il, {FOUR} FROM ampl")
def _(spark, d):
    return rounded(separable.amplitudes_separable(views.atoms_3d(spark, d), grid_3s(spark, d), ["ih", "ik", "il"], list("xyz"), ["xav", "yav", "zav"]))


@query("e5_separable_by_element", SQL["e5_forward_by_element"])
def _(spark, d):
    params = weights.form_factor_params(views.elements(spark).select(F.col("element"), F.lit(0).alias("charge")).where("element IN ('a', 'n', 'r')"), views.form_factors(spark))
    norm = F.sqrt(F.col("qh") * F.col("qh") + F.col("qk") * F.col("qk") + F.col("ql") * F.col("ql"))
    f = scalars.doyle_turner(scalars.reduced(norm), F.col("a"), F.col("b"), F.col("c"))
    atoms = views.atoms_3d(spark, d).withColumn("element", F.lower("element"))
    return rounded(separable.amplitudes_by_element_separable(atoms, grid_3s(spark, d), ["ih", "ik", "il"], list("xyz"), ["xav", "yav", "zav"], params, f))


def _line(axis: str) -> str:
    """Sums of exp(2 pi i n x) over n = 0 .. 64 for each coordinate that occurs."""
    return f"d{axis} AS (SELECT {axis}, sum(cos({TWO_PI} * i * {axis})) AS re, sum(sin({TWO_PI} * i * {axis})) AS im FROM (SELECT DISTINCT {axis} FROM atoms), range(0, 65) t(i) GROUP BY {axis})"


def grid_65(spark):
    """The grid of 65 x 65 x 65 points of a box of 64 cells along each axis, h, k and l from 0 to 1."""
    box = spark.createDataFrame([(0.0, 1.0) * 3], ", ".join(f"{a}_{e} double" for a in "hkl" for e in ("start", "end")))
    return grids.q_grid(box, [64, 64, 64])


@query("e4_separable_grid_65", f"{WITH3}, {_line('y')}, {_line('z')}, p AS (SELECT x, coeff, dy.re * dz.re - dy.im * dz.im AS re, dy.re * dz.im + dy.im * dz.re AS im FROM atoms JOIN dy USING (y) JOIN dz USING (z)), n AS (SELECT count(*) AS n FROM atoms) SELECT CAST(i AS INT) AS ih, 4225 AS points, {r(f'sum(coeff * (cos({TWO_PI} * i * x) * re - sin({TWO_PI} * i * x) * im)) / (4225e0 * any_value(n))', 'a_re')}, {r(f'sum(coeff * (cos({TWO_PI} * i * x) * im + sin({TWO_PI} * i * x) * re)) / (4225e0 * any_value(n))', 'a_im')} FROM p, n, range(0, 65) t(i) GROUP BY i")
def _(spark, d):
    """274 625 amplitudes of all atoms; their means over planes have a sum that SQL can take."""
    atoms = views.atoms_3d(spark, d)
    ampl = separable.amplitudes_separable(atoms, grid_65(spark), ["ih", "ik", "il"], list("xyz"), ["xav", "yav", "zav"])
    n = F.broadcast(atoms.agg(F.count(F.lit(1)).alias("n")))
    mean = ampl.groupBy("ih").agg(F.count(F.lit(1)).cast("int").alias("points"), F.avg("a_re").alias("a_re"), F.avg("a_im").alias("a_im"))
    return rounded(mean.crossJoin(n).select("ih", "points", (F.col("a_re") / F.col("n")).alias("a_re"), (F.col("a_im") / F.col("n")).alias("a_im")))


_RING = "h * h + k * k > 0.01e0 AND h >= 0"
AMPL2M = _ampl_sql(GRID2, [("qh", "x", "xav"), ("qk", "y", "yav")], "coeff", "ih, ik, qh, qk", _RING)


def _spread(where: str, places: str, keys: str) -> str:
    """The field of all points of ``places`` from the table ``ampl``."""
    return f"field AS (SELECT {keys}, sum((a_re - av_re) * c - (a_im - av_im) * s) AS d_re, sum((a_re - av_re) * s + (a_im - av_im) * c) AS d_im, sum(av_re * c - av_im * s) AS av_re, sum(av_re * s + av_im * c) AS av_im FROM (SELECT p.*, ampl.*, cos({where}) AS c, -sin({where}) AS s FROM {places} p, ampl) GROUP BY {keys})"


for _name, _ampl, _mask in (("e6_patches_2d", AMPL2, None), ("e6_patches_2d_masked", AMPL2M, "h * h + k * k > 0.01D AND h >= 0")):

    @query(_name, f"{WITH2}, {_PATCH}, {_ampl}, {_spread('qh * px + qk * py', 'patch', 'site_id, point_no, px, py')} SELECT site_id, point_no, {r('px')}, {r('py')}, {', '.join(r(f'{x} / 1e4', x) for x in separable.FIELD)} FROM field")
    def _(spark, d, mask=_mask):
        """Patches of up to 49 points; the masked grid is sparse, so its points are taken one by one."""
        atoms, chosen = views.atoms_2d(spark, d), patches(spark, d)
        ampl = separable.amplitudes_separable(atoms, grid_2d(spark, d, masks.mask_equation(mask) if mask else None), ["ih", "ik"], ["x", "y"], ["xav", "yav"])
        rows = separable.patch_rows(separable.residual_patches(ampl, chosen, ["ih", "ik"], ["x", "y"]), chosen, ["x", "y"])
        return rounded(rows.withColumns({v: F.col(v) / 1e4 for v in separable.FIELD}))


_BOXES = "patch AS (SELECT CAST(cell_x * 20 + cell_y AS BIGINT) AS site_id, CAST((i * 3 + j) * 1 AS BIGINT) AS point_no, cell_x / 20e0 + (i - 1) * 0.01e0 AS px, cell_y / 20e0 + (j - 1) * 0.02e0 AS py, 0.5e0 AS pz FROM (SELECT DISTINCT cell_x, cell_y FROM atoms), range(0, 3) a(i), range(0, 3) b(j))"


@query("e6_patches_3d", f"{WITH3}, {_BOXES}, {AMPL3}, {_spread('qh * px + qk * py + ql * pz', 'patch', 'site_id, point_no')} SELECT site_id, point_no, {', '.join(r(f'{x} / 1e3', x, places=5) for x in ('d_re', 'd_im', 'av_re', 'av_im'))} FROM field")
def _(spark, d):
    atoms = views.atoms_3d(spark, d)
    ampl = separable.amplitudes_separable(atoms, grid_3s(spark, d), ["ih", "ik", "il"], list("xyz"), ["xav", "yav", "zav"])
    places = atoms.select("cell_x", "cell_y").distinct()
    at = places.select((F.col("cell_x") * 20 + F.col("cell_y")).cast("bigint").alias("site_id"), (F.col("cell_x") / 20).alias("x"), (F.col("cell_y") / 20).alias("y"), F.lit(0.5).alias("z"), F.array(F.lit(0.01 + 1e-12), F.lit(0.02 + 1e-12), F.lit(0.0)).alias("dist"), F.array(F.lit(0.01), F.lit(0.02), F.lit(0.0)).alias("step"))
    rows = separable.patch_rows(separable.residual_patches(ampl, at, ["ih", "ik", "il"], list("xyz")), at, list("xyz"))
    return rounded(rows.select("site_id", "point_no", *((F.col(v) / 1e3).alias(v) for v in separable.FIELD)), places=5)


@query("chemical_contrast_separable", SQL["chemical_contrast_1d"])
def _(spark, d):
    """The flagship run by separable sums."""
    atoms = views.atoms_2d(spark, d)
    return rounded(flows.chemical_contrast(atoms, views.box_spec(atoms, 1), 1, disc(), form="separable"))


# --- files read in splits ------------------------------------------------------------------------------------------------------------


def _written(df, line, path: str, head: str | None = None) -> str:
    """Text of a table in the order of its rows' ``o``, in one file, under a header."""
    rows = df.select(F.col("o"), line.alias("value"))
    if head is not None:
        rows = rows.unionByName(df.sparkSession.createDataFrame([(-1, head)], "o bigint, value string"))
    rows.repartitionByRange(1, "o").sortWithinPartitions("o").select("value").write.text(path)
    return path


@query("a5_coefficients_file", SQL["a5_coefficients_by_position"])
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("o"), (F.col("p_size").cast("double") * 2.0).alias("value"))
    listed = structures.read_coefficients(spark, _written(part, F.col("value").cast("string"), tables.scratch(spark)))
    return weights.coefficients_by_position(views.atoms_2d(spark, d).select("site_id"), listed.select("row_no", "value")).select("site_id", "coeff")


@query("a6_reflections_file", SQL["a6_read_reflections"])
def _(spark, d):
    listed = spark.createDataFrame([(i, *x) for i, x in enumerate(LISTED)], "o bigint, h double, k double, l double")
    path = _written(listed, F.concat_ws("  ", "h", "k", "l"), tables.scratch(spark), " h k l")
    return masks.read_box(structures.read_reflections(spark, path), grid_3d(spark, d))


@query("a7_form_factors_file", SQL["a7_form_factors"])
def _(spark, d):
    path, nested = tables.scratch(spark), {}
    for element, charge, a, b, c in views.FORM_FACTORS:
        nested.setdefault(element.upper(), {})[str(charge)] = {"a": a, "b": b, "c": c}
    spark.createDataFrame([(json.dumps(nested, indent=1),)], "value string").write.text(path)
    atoms = views.atoms_3d(spark, d).select("site_id", "element", (F.col("refnumber") % 3).alias("charge"), (F.col("refnumber") * 1.5).alias("q"))
    found = weights.form_factor_params(atoms, structures.read_form_factors(spark, path))
    g = scalars.reduced(F.col("q"))
    return rounded(found.select("site_id", *(weights.FORM_FACTORS[k](g, F.col("a"), F.col("b"), F.col("c")).alias(k) for k in ("doyle_turner", "peng", "lobato"))))


@query("a4_points_in_splits", f"{WITH2} SELECT row_number() OVER (ORDER BY site_id) - 1 AS point_no, {r('x')}, {r('y')} FROM atoms")
def _(spark, d):
    """One file of all points, cut into as many splits as Spark makes of it."""
    atoms = views.atoms_2d(spark, d).withColumn("o", F.col("site_id").cast("bigint"))
    path = _written(atoms, F.concat_ws(" ", "x", "y"), tables.scratch(spark))
    return rounded(structures.read_points(spark, path, 2).select("point_no", *(F.col("p")[i].alias(a) for i, a in enumerate("xy"))))


@query("a4_points_of_one_axis", f"{WITH2} SELECT row_number() OVER (ORDER BY site_id) - 1 AS point_no, {r('x')} FROM atoms")
def _(spark, d):
    """Several values in a line are one column."""
    atoms = views.atoms_2d(spark, d).groupBy((F.floor(F.col("site_id") / 7)).alias("o")).agg(F.sort_array(F.collect_list(F.struct("site_id", "x"))).alias("s"))
    path = _written(atoms, F.concat_ws(" ", F.transform("s.x", lambda x: x.cast("string"))), tables.scratch(spark))
    return rounded(structures.read_points(spark, path, 1).select("point_no", F.col("p")[0].alias("x")))


# --- runs that go on -----------------------------------------------------------------------------------------------------------------


@query("resumed_run", f"{WITH2}, {AMPL1M}, {FIELD1} SELECT site_id, {', '.join(r(x + ' / 81e0', x) for x in ('d_re', 'd_im', 'av_re', 'av_im'))} FROM field")
def _(spark, d):
    """A run that breaks off after a wave, goes on, and is extended to more intervals equals a single one."""
    path, atoms = tables.scratch(spark), views.atoms_2d(spark, d)
    at = atoms.select("site_id", F.col("xav").alias("x"), F.array(F.lit(0.0)).alias("dist"), F.array(F.lit(0.0)).alias("step"), (F.col("site_id") % 3).cast("int").alias("chunk_id"))
    half, whole = views.box_spec(atoms, 1, 0.5, 0.25), views.box_spec(atoms, 1, 1.0, 0.25)
    flows.advance(atoms, at, half, 1, disc(), ["x"], ["xav"], path, at_once=2, waves=1)
    flows.advance(atoms, at, half, 1, disc(), ["x"], ["xav"], path)
    flows.advance(atoms, at, whole, 1, disc(), ["x"], ["xav"], path)
    field = flows.collected(spark, whole, 1, path)
    return rounded(field.select("site_id", *(F.col(v)[0].alias(v) for v in separable.FIELD)))
