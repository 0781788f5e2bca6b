"""Registered queries of the scattering operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complexcols as C
from ..functions import lattice, scalars
from ..operators import analysis, decoder, features, grids, masks, ranges, residual, scattering, sites, weights
from ..sources import structures, tables
from . import flows, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WITH2 = f"WITH atoms AS ({views.ATOMS_2D})"
WITH3 = f"WITH atoms AS ({views.ATOMS_3D})"
TWO_PI = "6.283185307179586e0"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, *keep: str, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison, without negative zero."""
    return df.select(*((F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def r(x: str, name: str | None = None, places: int = 6) -> str:
    """The same in SQL."""
    return f"round({x}, {places}) + 0e0 AS {name or x}"


def values(rows: list[tuple], names: str) -> str:
    def one(v) -> str:
        return f"'{v}'" if isinstance(v, str) else repr(v) + "e0" if isinstance(v, float) and "e" not in repr(v) else repr(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, x)) + ')' for x in rows)}) AS v({names}))"


ELEMENT_SQL = values(views.ELEMENTS, "element, z, b")

# --- lattice -----------------------------------------------------------------------------------------------------------------

OBLIQUE = [[2.0, 0.0], [0.5, 3.0]]


@query("b1_apply_lattice", f"{WITH2} SELECT site_id, {r('x * 2e0 + y * 0.5e0', 'x')}, {r('y * 3e0', 'y')} FROM atoms")
def _(spark, d):
    return rounded(lattice.apply_lattice(views.atoms_2d(spark, d).select("site_id", "x", "y"), OBLIQUE, ["x", "y"]))


CELLS = "SELECT s_suppkey AS cell_id, 4e0 + s_suppkey % 5 AS a, 5e0 + s_suppkey % 3 AS b, 6e0 + s_suppkey % 7 AS c, 80e0 + s_suppkey % 11 AS al, 85e0 + s_suppkey % 7 AS be, 75e0 + s_suppkey % 13 AS ga FROM supplier"
VECTORS = """
vec AS (SELECT *, a AS v11, 0e0 AS v12, 0e0 AS v13, b * cos(radians(ga)) AS v21, b * sin(radians(ga)) AS v22, 0e0 AS v23,
  c * cos(radians(be)) AS v31, c * (cos(radians(al)) - cos(radians(be)) * cos(radians(ga))) / sin(radians(ga)) AS v32 FROM cells),
vectors AS (SELECT *, sqrt(c * c - v31 * v31 - v32 * v32) AS v33 FROM vec)"""
V_NAMES = [f"v{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


def cells(spark, d):
    return lattice.cell_vectors(views.view(spark, d, "supplier", CELLS), ["a", "b", "c", "al", "be", "ga"])


@query("b2_cell_vectors", f"WITH cells AS ({CELLS}), {VECTORS} SELECT cell_id, {', '.join(r(v) for v in V_NAMES)} FROM vectors")
def _(spark, d):
    return rounded(cells(spark, d).select("cell_id", *V_NAMES))


def _cross(a, b):
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


_AX, _BX, _CX = ([f"v{i}{j}" for i in (1, 2, 3)] for j in (1, 2, 3))
_RECIPROCAL = [_cross(_BX, _CX), _cross(_CX, _AX), _cross(_AX, _BX)]
_VOLUME = " + ".join(f"{x} * {y}" for x, y in zip(_AX, _RECIPROCAL[0], strict=True))


@query("b3_cell_metric", f"WITH cells AS ({CELLS}), {VECTORS} SELECT cell_id, {r(_VOLUME, 'size')}, {', '.join(r(f'{TWO_PI} * {x} / ({_VOLUME})', f'r{i + 1}{j + 1}') for i, row in enumerate(_RECIPROCAL) for j, x in enumerate(row))} FROM vectors")
def _(spark, d):
    out = lattice.cell_metric(cells(spark, d), 3)
    return rounded(out.select("cell_id", "size", *(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))))


# inverse of the transposed vectors: [[1/2, -1/12], [0, 1/3]]
@query("b4_to_fractional", f"{WITH2} SELECT site_id, {r('x / 2e0', 'x')}, {r('y / 3e0 - x / 12e0', 'y')} FROM atoms")
def _(spark, d):
    return rounded(lattice.to_fractional(views.atoms_2d(spark, d).select("site_id", "x", "y"), OBLIQUE, ["x", "y"]))


@query("b5_cell_origins", f"{WITH3} SELECT site_id, {r('cell_x / 20e0 * 4e0', 'ox')}, {r('cell_y / 20e0 * 5e0', 'oy')}, {r('cell_z / 20e0 * 6e0', 'oz')} FROM atoms")
def _(spark, d):
    return rounded(lattice.cell_origins(views.atoms_3d(spark, d), ["cell_x", "cell_y", "cell_z"], [20, 20, 20], [[4.0, 0, 0], [0, 5.0, 0], [0, 0, 6.0]], ["ox", "oy", "oz"]).select("site_id", "ox", "oy", "oz"))


@query("b8_displacement_target", f"{WITH2} SELECT site_id, {r('4e0 * ((x - xav) - round_even(x - xav, 0))', 'ux')}, {r('5e0 * ((y - yav) - round_even(y - yav, 0))', 'uy')} FROM atoms")
def _(spark, d):
    box = [[4.0, 0.0], [0.0, 5.0]]
    at = [F.col("x") * 4.0, F.col("y") * 5.0], [F.col("xav") * 4.0, F.col("yav") * 5.0]
    ux, uy = lattice.minimum_image(*at, box)
    return rounded(views.atoms_2d(spark, d).select("site_id", ux.alias("ux"), uy.alias("uy")))


# --- sites and weights -----------------------------------------------------------------------------------------------------------


@query("b6_filter_cell_box", f"{WITH3} SELECT site_id, cell_x, cell_y, cell_z FROM atoms WHERE cell_x BETWEEN 2 AND 7 AND cell_z <= 4")
def _(spark, d):
    return sites.filter_cell_box(views.atoms_3d(spark, d), [2, None, None], [7, None, 4]).select("site_id", "cell_x", "cell_y", "cell_z")


#: Rules for the sites of the two-dimensional table (fixed values).
RULES = [(1, "ECONOMY", 1, 0.01, 0.05), (2, "PROMO", 1, 0.01, 0.05), (3, "ECONOMY", 1, 0.03, 0.01), (4, "LARGE", 1, 0.02, 0.01)]
RULE_SQL = values(RULES, "rule_no, element, refnumber, d, s")


def site_rules(spark):
    listed = spark.createDataFrame([(n, e, [m], [dist] * 2, [step] * 2) for n, e, m, dist, step in RULES], "rule_no int, element string, refnumbers array<int>, dist array<double>, step array<double>")
    return sites.expand_rules(listed)


@query("b7_select_sites", f"{WITH2}, m AS (SELECT a.site_id, u.rule_no, u.d AS dist, u.s AS step, row_number() OVER (PARTITION BY a.site_id ORDER BY u.rule_no) AS n FROM atoms a JOIN {RULE_SQL} u ON a.element = u.element AND a.refnumber = u.refnumber) SELECT site_id, rule_no, dist, step FROM m WHERE n = 1")
def _(spark, d):
    out = sites.select_sites(views.atoms_2d(spark, d), site_rules(spark))
    return out.select("site_id", "rule_no", F.col("dist")[0].alias("dist"), F.col("step")[0].alias("step"))


@query("b9_normalize_element", f"SELECT p_partkey AS site_id, lower(trim('  ' || p_type || '2+ ')) AS name, regexp_replace(lower(trim('  ' || p_type || '2+ ')), '[^a-z0-9]', '', 'g') AS stripped FROM part")
def _(spark, d):
    name = F.concat(F.lit("  "), F.col("p_type"), F.lit("2+ "))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("site_id"), weights.normalize_element(name).alias("name"), weights.strip_element(name).alias("stripped"))


@query("b10_assign_coefficients", f"{WITH2} SELECT a.site_id, 1e0 AS ones, e.z AS atomic_number, e.b AS neutron, a.coeff AS config FROM atoms a JOIN {ELEMENT_SQL} e ON lower(a.element) = e.element")
def _(spark, d):
    e = views.elements(spark)
    out = weights.assign_coefficients(views.atoms_2d(spark, d).withColumnRenamed("coeff", "given"), "ones", out="ones")
    out = weights.assign_coefficients(out, "atomic_number", e, out="atomic_number")
    out = weights.assign_coefficients(out, "neutron", e, out="neutron")
    return weights.assign_coefficients(out, "config", column="given", out="config").select("site_id", "ones", "atomic_number", "neutron", "config")


@query("a5_coefficients_by_position", f"{WITH2}, v AS (SELECT row_number() OVER (ORDER BY p_partkey) AS n, CAST(p_size AS DOUBLE) * 2e0 AS value FROM part), t AS (SELECT site_id, row_number() OVER (ORDER BY site_id) AS n FROM atoms) SELECT t.site_id, v.value AS coeff FROM t JOIN v USING (n)")
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size").cast("double") * 2.0).alias("value"))
    listed = sites.numbered(part, ["p_partkey"]).select("row_no", "value")
    return weights.coefficients_by_position(views.atoms_2d(spark, d).select("site_id"), listed).select("site_id", "coeff")


@query("e2_center_coefficients", f"{WITH2} SELECT site_id, {r('coeff - avg(coeff) OVER ()', 'by_all')}, {r('coeff - avg(coeff) OVER (PARTITION BY refnumber)', 'by_refnumber')} FROM atoms")
def _(spark, d):
    atoms = views.atoms_2d(spark, d).select("site_id", "refnumber", F.col("coeff").alias("by_all"), F.col("coeff").alias("by_refnumber"))
    out = weights.center_coefficients(atoms, "global", "by_all")
    return rounded(weights.center_coefficients(out, "refnumbers", "by_refnumber").select("site_id", "by_all", "by_refnumber"))


_OFF = ", ".join(f"CASE WHEN {a} - cell_{a} / 20e0 < -0.5e0 THEN {a} - cell_{a} / 20e0 + 1e0 WHEN {a} - cell_{a} / 20e0 > 0.5e0 THEN {a} - cell_{a} / 20e0 - 1e0 ELSE {a} - cell_{a} / 20e0 END AS d{a}" for a in "xyz")
_AVG = ", ".join(f"cell_{a} / 20e0 + avg(d{a}) OVER (PARTITION BY element, refnumber) AS p{a}" for a in "xyz")
_WRAP = ", ".join(r(f"CASE WHEN p{a} < 0 THEN p{a} + 1e0 WHEN p{a} > 1 THEN p{a} - 1e0 ELSE p{a} END", f"{a}av") for a in "xyz")


@query("e1_average_structure", f"{WITH3}, o AS (SELECT *, {_OFF} FROM atoms), p AS (SELECT site_id, {_AVG} FROM o) SELECT site_id, {_WRAP} FROM p")
def _(spark, d):
    return rounded(weights.average_structure(views.atoms_3d(spark, d).drop("xav", "yav", "zav"), [20, 20, 20]).select("site_id", "xav", "yav", "zav"))


@query("d1_attach_average", f"{WITH3} SELECT site_id, element, {r('x - xav', 'dx')}, {r('z - zav', 'dz')} FROM atoms")
def _(spark, d):
    atoms = views.atoms_3d(spark, d)
    other = atoms.select("site_id", "element", F.col("xav").alias("x"), F.col("yav").alias("y"), F.col("zav").alias("z"))
    out = weights.attach_average(atoms.drop("xav", "yav", "zav"), other)
    return rounded(out.select("site_id", "element", (F.col("x") - F.col("xav")).alias("dx"), (F.col("z") - F.col("zav")).alias("dz")))


@query("d2_attach_weights", f"{WITH2} SELECT a.site_id, coalesce(e.b, 10e0) AS weight FROM atoms a LEFT JOIN (SELECT * FROM {ELEMENT_SQL} WHERE element <> 'promo') e ON lower(a.element) = e.element")
def _(spark, d):
    return weights.attach_weights(views.atoms_2d(spark, d), views.elements(spark).where("element <> 'promo'"), "b", "weight", 10.0).select("site_id", "weight")


@query("d6_map_matrix", f"{WITH2}, m AS (SELECT cell_y AS i, cell_x AS j, CAST(sum(coeff) AS DOUBLE) AS value FROM atoms GROUP BY cell_y, cell_x) SELECT a.site_id, m.value AS matrix_value FROM atoms a JOIN m ON m.i = least(greatest(round_even(a.yav * 50e0, 0), 0e0), 49e0) AND m.j = least(greatest(round_even(a.xav * 40e0, 0), 0e0), 39e0)")
def _(spark, d):
    atoms = views.atoms_2d(spark, d)
    matrix = atoms.groupBy(F.col("cell_y").alias("i"), F.col("cell_x").alias("j")).agg(F.sum("coeff").alias("value"))
    return weights.map_matrix(atoms, matrix, 40, 50).select("site_id", "matrix_value")


FF_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{e}', {q}, {a}, {b}, {c}e0)" for e, q, a, b, c in views.FORM_FACTORS) + ") AS v(element, charge, a, b, c))"


@query("a7_form_factors", f"{WITH3}, s AS (SELECT site_id, lower(element) AS element, refnumber % 3 AS charge, refnumber * 1.5e0 AS q FROM atoms), p AS (SELECT s.*, coalesce(o.a, z.a) AS a, coalesce(o.b, z.b) AS b, coalesce(o.c, z.c) AS c, power(q / 12.566370614359172e0, 2e0) AS g FROM s LEFT JOIN {FF_SQL} o ON o.element = s.element AND o.charge = s.charge LEFT JOIN {FF_SQL} z ON z.element = s.element AND z.charge = 0) SELECT site_id, {r('a[1] * exp(-b[1] * g) + a[2] * exp(-b[2] * g) + c', 'doyle_turner')}, {r('a[1] * exp(-b[1] * g) + a[2] * exp(-b[2] * g)', 'peng')}, {r('a[1] * (2e0 + b[1] * g) / power(1e0 + b[1] * g, 2e0) + a[2] * (2e0 + b[2] * g) / power(1e0 + b[2] * g, 2e0)', 'lobato')} FROM p")
def _(spark, d):
    atoms = views.atoms_3d(spark, d).select("site_id", "element", (F.col("refnumber") % 3).alias("charge"), (F.col("refnumber") * 1.5).alias("q"))
    with_params = weights.form_factor_params(atoms, views.form_factors(spark))
    g = scalars.reduced(F.col("q"))
    return rounded(with_params.select("site_id", *(weights.FORM_FACTORS[k](g, F.col("a"), F.col("b"), F.col("c")).alias(k) for k in ("doyle_turner", "peng", "lobato"))))


def batches(spark, d):
    return views.atoms_2d(spark, d).select("site_id")


_N7 = f"{WITH2}, n AS (SELECT site_id, row_number() OVER (ORDER BY site_id) - 1 AS k, count(*) OVER () AS t FROM atoms)"


@query("f1_batch_even", f"{WITH2} SELECT site_id, CAST(ntile(7) OVER (ORDER BY site_id) - 1 + 3 AS INT) AS chunk_id FROM atoms")
def _(spark, d):
    return sites.batch_even(batches(spark, d), 7, ["site_id"], 3).select("site_id", "chunk_id")


@query("f2_batch_floor", f"{_N7} SELECT site_id, CAST(floor(k / greatest(1, floor(t / 7e0))) AS INT) AS chunk_id FROM n")
def _(spark, d):
    return sites.batch_floor(batches(spark, d), 7, ["site_id"]).select("site_id", "chunk_id")


@query("f3_batch_ceil", f"{_N7} SELECT site_id, CAST(floor(k / greatest(1, ceil(t / 7e0))) AS INT) AS chunk_id FROM n")
def _(spark, d):
    return sites.batch_ceil(batches(spark, d), 7, ["site_id"]).select("site_id", "chunk_id")


@query("f5_first_wins", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey AS site_id, o_orderkey AS first_order FROM o WHERE n = 1")
def _(spark, d):
    return sites.first_wins(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("first_order"))


def _kept_sql(tol: str) -> str:
    """Values by element, each the first one more than ``tol`` above the one kept before it."""
    return f"{WITH3}, v AS (SELECT DISTINCT element, x FROM atoms), kept AS (SELECT element, x FROM (WITH RECURSIVE k AS (SELECT element, min(x) AS x FROM v GROUP BY element UNION ALL SELECT k.element, min(v.x) AS x FROM k JOIN v ON v.element = k.element AND v.x - k.x > {tol} GROUP BY k.element, k.x) SELECT * FROM k))"


@query("f6_distinct_tol", f"{_kept_sql('1e-10')} SELECT element, count(*) AS kept FROM kept GROUP BY element")
def _(spark, d):
    return ranges.distinct_tol_rows(views.atoms_3d(spark, d), ["element"], "x").groupBy("element").agg(F.count(F.lit(1)).alias("kept"))


@query("f6_distinct_tol_chains", f"{_kept_sql('3.3e-4')} SELECT element, {r('x')} FROM kept")
def _(spark, d):
    """Values closer than the tolerance follow each other in chains, which are cut at range borders here."""
    return rounded(ranges.distinct_tol_rows(views.atoms_3d(spark, d), ["element"], "x", 3.3e-4, ranges=9))


@query("i1_append_unseen", f"{WITH2} SELECT site_id, CASE WHEN site_id % 3 = 0 THEN 'old' ELSE 'new' END AS source FROM atoms")
def _(spark, d):
    atoms = views.atoms_2d(spark, d).select("site_id")
    return sites.append_unseen(atoms.withColumn("source", F.lit("new")), atoms.where("site_id % 3 = 0").withColumn("source", F.lit("old")))


_P6 = f"{WITH2}, p AS (SELECT refnumber AS file, site_id AS point_no, x, y FROM atoms), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY point_no) - 1 AS k, count(*) OVER (PARTITION BY file) AS t, row_number() OVER (ORDER BY point_no) - 1 AS ka, count(*) OVER () AS ta FROM p)"


@query("g6_sites_central", f"{_P6} SELECT file, k AS site_id, CAST(floor(k / greatest(1, floor(t / 5e0))) AS INT) AS chunk_id, {r('x / 2e0', 'x')}, {r('y / 3e0', 'y')} FROM n")
def _(spark, d):
    points = views.atoms_2d(spark, d).select(F.col("refnumber").alias("file"), F.col("site_id").alias("point_no"), "x", "y")
    out = sites.sites_from_points(points, [[2.0, 0.0], [0.0, 3.0]], ["x", "y"], [0.1, 0.1], [0.05, 0.05], 5, True, ["point_no"])
    return rounded(out.select("file", "site_id", "chunk_id", "x", "y"))


@query("g6_sites_full_list", f"{_P6} SELECT ka AS site_id, CAST(floor(ka / greatest(1, ceil(ta / 5e0))) AS INT) AS chunk_id, {r('x / 2e0', 'x')}, {r('y / 3e0', 'y')} FROM n")
def _(spark, d):
    points = views.atoms_2d(spark, d).select(F.col("refnumber").alias("file"), F.col("site_id").alias("point_no"), "x", "y")
    out = sites.sites_from_points(points, [[2.0, 0.0], [0.0, 3.0]], ["x", "y"], [0.0, 0.0], [0.0, 0.0], 5, False, ["point_no"])
    return rounded(out.select("site_id", "chunk_id", "x", "y"))


# --- intervals and grids ---------------------------------------------------------------------------------------------------------

SPECS = "SELECT s_suppkey AS spec_id, " + ", ".join(f"1e0 + s_suppkey % {m} AS {a}_limit, 1e0 AS {a}_step, 4e0 + 4e0 * (s_suppkey % 2) AS {a}_size, CAST(s_suppkey % 2 AS DOUBLE) AS {a}_before" for a, m in (("h", 3), ("k", 2), ("l", 2))) + " FROM supplier"


def _axis_sql(a: str) -> str:
    up = f"SELECT spec_id, i AS no, CASE WHEN i = 0 THEN {'1e0 / l_size' if a == 'l' else '0e0'} ELSE i * {a}_step + 1e0 / {a}_size END AS s, least((i + 1) * {a}_step, {a}_limit) AS e FROM specs, range(0, 8) t(i) WHERE i < ceil({a}_limit / {a}_step)"
    if a == "l":
        return f"{up} UNION ALL SELECT spec_id, -1 AS no, 0e0 AS s, 0e0 AS e FROM specs"
    return f"{up} UNION ALL SELECT spec_id, -i - 1 AS no, -least((i + 1) * {a}_step, {a}_limit) AS s, -(i * {a}_step + 1e0 / {a}_size) AS e FROM specs, range(0, 8) t(i) WHERE i < ceil({a}_limit / {a}_step)"


def _intervals_sql(previous: bool) -> str:
    old = {a: f"sp.{a}_before" if previous else "0e0" for a in "hkl"}
    fresh = f"(abs(h.e) > {old['h']} OR abs(k.e) > {old['k']}"
    return (
        f"specs AS ({SPECS}), hr AS ({_axis_sql('h')}), kr AS ({_axis_sql('k')}), lr AS ({_axis_sql('l')}), "
        "intervals AS (SELECT spec_id, h.s AS h_start, h.e AS h_end, k.s AS k_start, k.e AS k_end, l.s AS l_start, l.e AS l_end "
        f"FROM specs sp JOIN hr h USING (spec_id) JOIN kr k USING (spec_id) JOIN lr l USING (spec_id) WHERE {fresh} OR (l.no >= 0 AND abs(l.e) > {old['l']})))"
    )


ENDS = [f"{a}_{e}" for a in "hkl" for e in ("start", "end")]


def intervals_3d(spark, d, previous=False):
    specs = views.view(spark, d, "supplier", SPECS)
    return grids.make_intervals(specs, 3, ["h_before", "k_before", "l_before"] if previous else None), specs


@query("g1_make_intervals", f"WITH {_intervals_sql(False)} SELECT spec_id, {', '.join(r(e) for e in ENDS)} FROM intervals")
def _(spark, d):
    return rounded(intervals_3d(spark, d)[0])


@query("g2_extend_intervals", f"WITH {_intervals_sql(True)} SELECT spec_id, {', '.join(r(e) for e in ENDS)} FROM intervals")
def _(spark, d):
    return rounded(intervals_3d(spark, d, True)[0])


@query("i2_interval_union", f"WITH {_intervals_sql(False)} SELECT DISTINCT spec_id, {', '.join(r(e) for e in ENDS)} FROM intervals")
def _(spark, d):
    all_of = intervals_3d(spark, d)[0]
    return rounded(grids.extend_intervals(all_of, all_of.where("h_start >= 0"), 3))


_COUNT = "*".join(f"(floor(({a}_end - {a}_start) * {a}_size + 0.5e0) + 1)" for a in "hkl")


@query("e8_count_reciprocal_points", f"WITH {_intervals_sql(False)} SELECT spec_id, CAST(sum({_COUNT} * CASE WHEN l_start = 0 AND l_end = 0 THEN 1 ELSE 2 END) AS BIGINT) AS points FROM intervals JOIN specs USING (spec_id) GROUP BY spec_id")
def _(spark, d):
    made, specs = intervals_3d(spark, d)
    sized = made.join(specs.select("spec_id", "h_size", "k_size", "l_size"), "spec_id")
    return sized.groupBy("spec_id").agg(F.sum(grids.count_reciprocal_points([F.col(f"{a}_size") for a in "hkl"])).cast("bigint").alias("points"))


@query("e12_hkl_max", f"WITH {_intervals_sql(False)} SELECT {', '.join(f'max(greatest(abs({a}_start), abs({a}_end))) AS {a}_max' for a in 'hkl')} FROM intervals")
def _(spark, d):
    return grids.hkl_max(intervals_3d(spark, d)[0], 3)


GRID3 = f"{_intervals_sql(False)}, " + """
axes AS (SELECT i.*, h_size, k_size, l_size FROM intervals i JOIN specs USING (spec_id)),
grid AS (SELECT spec_id, CAST(h.i AS INT) AS ih, CAST(k.i AS INT) AS ik, CAST(l.i AS INT) AS il, h.i / h_size AS h, k.i / k_size AS k, l.i / l_size AS l
  FROM axes JOIN range(-40, 41) h(i) ON h.i BETWEEN ceil(h_start * h_size) AND floor(h_end * h_size)
  JOIN range(-40, 41) k(i) ON k.i BETWEEN ceil(k_start * k_size) AND floor(k_end * k_size)
  JOIN range(-40, 41) l(i) ON l.i BETWEEN ceil(l_start * l_size) AND floor(l_end * l_size))"""


def grid_3d(spark, d, mask=None):
    made, specs = intervals_3d(spark, d)
    sized = made.join(specs.select("spec_id", "h_size", "k_size", "l_size"), "spec_id")
    return grids.q_grid(sized, [F.col(f"{a}_size") for a in "hkl"], mask)


def bounds_3d(spark, d, axes):
    made, specs = intervals_3d(spark, d)
    sized = made.join(specs.select("spec_id", "h_size", "k_size", "l_size"), "spec_id")
    return grids.axis_bounds(sized, [F.col(f"{a}_size") for a in "hkl"], axes)


def counted(df, *by):
    """Digest of a set of grid points: their number and index sums."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("ih") + 3 * F.col("ik") + 7 * F.col("il")).cast("bigint").alias("index_sum"))


COUNTED = "count(*) AS points, CAST(sum(ih + 3 * ik + 7 * il) AS BIGINT) AS index_sum"


@query("g3_q_grid", f"WITH {GRID3} SELECT spec_id, {COUNTED} FROM grid WHERE h + k <= 1.5e0 GROUP BY spec_id")
def _(spark, d):
    return counted(grid_3d(spark, d, F.col("h") + F.col("k") <= 1.5), "spec_id")


@query("e10_accepted_count", f"WITH {GRID3} SELECT spec_id, count(*) * CASE WHEN max(abs(l)) > 1e-7 THEN 2 ELSE 1 END AS accepted FROM grid WHERE h > 0 GROUP BY spec_id")
def _(spark, d):
    return grids.accepted_count(grid_3d(spark, d, F.col("h") > 0), ["spec_id"])


@query("b12_q_to_hkl", f"WITH {GRID3} SELECT spec_id, ih, ik, il, {r('4e0 * (h * ' + TWO_PI + ' * 10e0 / 4e0) / (10e0 * ' + TWO_PI + ')', 'h')} FROM grid WHERE ik = 0")
def _(spark, d):
    q = F.col("h") * lattice.TWO_PI * 10.0 / 4.0
    return rounded(grid_3d(spark, d, F.col("ik") == 0).select("spec_id", "ih", "ik", "il", lattice.q_to_hkl(q, 4.0, 10).alias("h")))


def patches(spark, d):
    chosen = sites.select_sites(views.atoms_2d(spark, d), site_rules(spark))
    return chosen.select("site_id", F.col("xav").alias("x"), F.col("yav").alias("y"), "dist", "step")


_CHOSEN = f"m AS (SELECT a.site_id, a.xav AS x, a.yav AS y, u.d, u.s, row_number() OVER (PARTITION BY a.site_id ORDER BY u.rule_no) AS n FROM atoms a JOIN {RULE_SQL} u ON a.element = u.element AND a.refnumber = u.refnumber), site AS (SELECT site_id, x, y, d, s, CASE WHEN s <= 0 OR d <= s THEN 1 ELSE CAST(ceil((2e0 * d + s - 1e-8) / s) AS INT) END AS size FROM m WHERE n = 1)"
_PATCH = f"{_CHOSEN}, patch AS (SELECT site_id, i.i * size + j.i AS point_no, x + CASE WHEN size = 1 THEN 0e0 ELSE -d + i.i * s END AS px, y + CASE WHEN size = 1 THEN 0e0 ELSE -d + j.i * s END AS py, x, y FROM site JOIN range(0, 200) i(i) ON i.i < size JOIN range(0, 200) j(i) ON j.i < size)"


@query("g4_patch_grid", f"{WITH2}, {_PATCH} SELECT site_id, point_no, {r('px')}, {r('py')} FROM patch")
def _(spark, d):
    return rounded(grids.patch_grid(patches(spark, d), ["x", "y"]).select("site_id", "point_no", "px", "py"))


@query("g5_patch_size", f"{WITH2}, {_CHOSEN} SELECT site_id, CAST(power(floor((2e0 * d + s - 1e-8) / s) + 1, 2) AS BIGINT) AS points FROM site")
def _(spark, d):
    return patches(spark, d).select("site_id", grids.patch_size(2).alias("points"))


# --- masks -----------------------------------------------------------------------------------------------------------------------


@query("c1_mask_all", f"WITH {GRID3} SELECT spec_id, {COUNTED} FROM grid GROUP BY spec_id")
def _(spark, d):
    return counted(grid_3d(spark, d, masks.mask_all()), "spec_id")


EQUATION = "power(h - floor(h) - 0.5D, 2) <= 0.0625D AND NOT (abs(k) > 1 OR (l > 0.5D) <> (h > 0))"


@query("c2_mask_equation", f"WITH {GRID3} SELECT spec_id, {COUNTED} FROM grid WHERE power(h - floor(h) - 0.5e0, 2) <= 0.0625e0 AND NOT (abs(k) > 1 OR (l > 0.5e0) <> (h > 0)) GROUP BY spec_id")
def _(spark, d):
    return counted(grid_3d(spark, d, masks.mask_equation(EQUATION)), "spec_id")



@query("c8_mask_rod_shell", f"WITH {GRID3}, u AS (SELECT *, h - floor(h) - 0.5e0 AS u, k - floor(k) - 0.5e0 AS v, l - floor(l) - 0.5e0 AS w FROM grid) SELECT spec_id, sum(CASE WHEN u*u + v*v <= 0.1876e0 * 0.1876e0 AND u*u + v*v + w*w >= 0.2501e0 * 0.2501e0 THEN 1 ELSE 0 END)::BIGINT AS displacement, sum(CASE WHEN u*u + v*v > 0.1876e0 * 0.1876e0 AND u*u + v*v + w*w > 0.2501e0 * 0.2501e0 THEN 1 ELSE 0 END)::BIGINT AS chemical FROM u GROUP BY spec_id")
def _(spark, d):
    return grid_3d(spark, d).groupBy("spec_id").agg(*(F.sum(F.when(masks.mask_rod_shell(m), 1).otherwise(0)).alias(m) for m in ("displacement", "chemical")))


@query("c9_mask_custom", f"WITH {GRID3} SELECT spec_id, {COUNTED} FROM grid WHERE h + k + l > 2e0 GROUP BY spec_id")
def _(spark, d):
    return counted(masks.mask_custom(grid_3d(spark, d), masks.coordinate_sum_above(2.0)), "spec_id")


@query("c11_mask_partition", f"WITH {GRID3} SELECT CASE WHEN h > 0.5e0 THEN 'right' WHEN k > 0.5e0 THEN 'top' ELSE 'rest' END AS region, {COUNTED} FROM grid GROUP BY 1")
def _(spark, d):
    return counted(grid_3d(spark, d).withColumn("region", masks.mask_partition({"right": F.col("h") > 0.5, "top": F.col("k") > 0.5})), "region")


@query("i3_mask_complement", f"WITH {GRID3} SELECT spec_id, {COUNTED} FROM grid WHERE NOT (h + k <= 1.5e0) GROUP BY spec_id")
def _(spark, d):
    return counted(grid_3d(spark, d, ~(F.col("h") + F.col("k") <= 1.5)), "spec_id")


_DISC = "power(h - floor(h) - 0.5e0, 2) + power(k - floor(k) - 0.5e0, 2) <= 0.198e0 * 0.198e0"


@query("e21_mask_coverage", f"WITH {GRID3} SELECT spec_id, CAST(sum(CASE WHEN {_DISC} THEN 1 ELSE 0 END) AS BIGINT) AS kept, count(*) AS points, {r(f'100e0 * sum(CASE WHEN {_DISC} THEN 1 ELSE 0 END) / count(*)', 'percent')} FROM grid GROUP BY spec_id")
def _(spark, d):
    return rounded(grid_3d(spark, d).groupBy("spec_id").agg(*masks.mask_coverage(masks.circle_region())))


@query("l2_circle_region", f"WITH {GRID3} SELECT spec_id, {COUNTED} FROM grid WHERE {_DISC} GROUP BY spec_id")
def _(spark, d):
    return counted(grid_3d(spark, d, masks.circle_region()), "spec_id")


#: Special points (fixed values): h, k, l, radius.
SPECIAL = [(0.5, 0.25, 0.5, 0.2), (0.25, 0.0, 0.3, 0.15)]


def _images_sql(axes: str, source: str) -> str:
    """Candidates by the rule of C10 on each axis, bounds from the grid."""
    pad = "0e0" if len(axes) == 3 else "1e0"
    ctes = [f"b AS (SELECT {', '.join(f'min({a}) - {pad} AS {a}_low, max({a}) + {pad} AS {a}_high' for a in axes)} FROM {source})", f"sp AS (SELECT row_number() OVER () AS no, * FROM {values(SPECIAL, 'h, k, l, radius')})"]
    for a in axes:
        low, high = f"round({a}_low, 8)", f"round({a}_high, 8)"
        ctes.append(
            f"i{a} AS (SELECT DISTINCT no, radius, round(c, 8) AS c FROM (SELECT no, radius, n, sg, {low} AS lo, {high} AS hi, {a} AS a, CASE WHEN n = 0 THEN abs({a}) * sg ELSE sign(n) * (abs(n) + abs({a})) END AS c "
            f"FROM sp, b, range(-12, 13) t(n), (VALUES (-1), (1)) AS s(sg) WHERE n BETWEEN floor({a}_low) - 2 AND ceil({a}_high) + 1) "
            "WHERE CASE WHEN n = 0 THEN CASE WHEN a BETWEEN lo - 1 AND hi + 1 AND -a BETWEEN lo - 1 AND hi + 1 THEN c BETWEEN lo - 1 AND hi + 1 ELSE c BETWEEN lo AND hi END ELSE c BETWEEN lo AND hi AND sg = 1 END)"
        )
    joins = " JOIN ".join(f"i{a} ON i{a}.no = i{axes[0]}.no" if k else f"i{a}" for k, a in enumerate(axes))
    ctes.append(f"image AS (SELECT DISTINCT i{axes[0]}.radius, {', '.join(f'i{a}.c AS c_{a}' for a in axes)} FROM {joins})")
    return ", ".join(ctes)


def _near_sql(axes: str) -> str:
    gap = f"abs(g.{axes} - c_{axes}) <= radius" if len(axes) == 1 else f"{' + '.join(f'(g.{a} - c_{a}) * (g.{a} - c_{a})' for a in axes)} <= radius * radius"
    return f"WITH {GRID3}, {_images_sql(axes, 'grid')} SELECT spec_id, {COUNTED} FROM grid g WHERE EXISTS (SELECT 1 FROM image WHERE {gap}) GROUP BY spec_id"


def special(spark):
    return spark.createDataFrame(SPECIAL, "c_h double, c_k double, c_l double, radius double")


for _name, _axes in (("c3_mask_interval", "h"), ("c4_mask_circle", "hk"), ("c5_mask_sphere", "hkl")):

    @query(_name, _near_sql(_axes))
    def _(spark, d, axes=_axes):
        return counted(masks.mask_periodic(grid_3d(spark, d), special(spark), list(axes), bounds_3d(spark, d, axes)), "spec_id")


@query("c10_periodic_candidates", f"WITH {GRID3}, {_images_sql('h', 'grid')} SELECT no AS point_no, c AS candidate FROM ih")
def _(spark, d):
    bounds = bounds_3d(spark, d, "h").select((F.col("h_low") - 1.0).alias("low"), (F.col("h_high") + 1.0).alias("high"))
    points = spark.createDataFrame([(i + 1, p[0]) for i, p in enumerate(SPECIAL)], "point_no bigint, a double")
    return masks.periodic_candidates(points.crossJoin(F.broadcast(bounds)), "a", "low", "high").select("point_no", "candidate")


#: Ellipsoids (fixed values): centre, axes, angles.
BODIES = [(0.25, 0.25, 0.25, 0.3, 0.4, 0.5, 0.0, 0.0), (1.0, 0.5, 0.5, 0.6, 0.2, 0.3, 0.5, 0.25)]


@query("c6_mask_ellipsoid", f"WITH {GRID3}, e AS {values(BODIES, 'c_h, c_k, c_l, a1, a2, a3, theta, phi')}, t AS (SELECT g.*, a1, a2, a3, theta, cos(phi) * (h - c_h) - sin(phi) * (k - c_k) AS x, sin(phi) * (h - c_h) + cos(phi) * (k - c_k) AS y, l - c_l AS z FROM grid g, e), ok AS (SELECT DISTINCT spec_id, ih, ik, il FROM t WHERE power((cos(theta) * x + sin(theta) * z) / a1, 2) + power(y / a2, 2) + power((-sin(theta) * x + cos(theta) * z) / a3, 2) <= 1e0) SELECT spec_id, {COUNTED} FROM ok GROUP BY spec_id")
def _(spark, d):
    bodies = spark.createDataFrame(BODIES, "c_h double, c_k double, c_l double, axis_1 double, axis_2 double, axis_3 double, theta double, phi double")
    return counted(masks.mask_ellipsoid(grid_3d(spark, d), bodies), "spec_id")


#: Reflections (fixed values); some lie outside the grid.
LISTED = [(0.0, 0.0, 0.0), (0.5, 0.0, 0.0), (0.0, 0.5, 0.5), (1.5, 1.5, 1.5), (9.0, 9.0, 9.0)]


@query("a6_read_reflections", f"WITH {GRID3}, v AS {values(LISTED, 'h, k, l')} SELECT v.h, v.k, v.l FROM v, (SELECT {', '.join(f'min({a}) - 0.5e0 AS {a}0, max({a}) + 0.5e0 AS {a}1' for a in 'hkl')} FROM grid) b WHERE v.h BETWEEN h0 AND h1 AND v.k BETWEEN k0 AND k1 AND v.l BETWEEN l0 AND l1")
def _(spark, d):
    return masks.read_box(spark.createDataFrame(LISTED, "h double, k double, l double"), grid_3d(spark, d))


@query("c7_mask_reflections", f"WITH {GRID3}, v AS {values(LISTED, 'h, k, l')} SELECT spec_id, {COUNTED} FROM grid g WHERE EXISTS (SELECT 1 FROM v WHERE round_even(v.h * 8e0, 0) = g.ih AND round_even(v.k * 8e0, 0) = g.ik AND round_even(v.l * 8e0, 0) = g.il) GROUP BY spec_id")
def _(spark, d):
    listed = spark.createDataFrame(LISTED, "h double, k double, l double")
    return counted(masks.mask_reflections(grid_3d(spark, d), listed, [8, 8, 8]), "spec_id")



@query("mask_functions", f"SELECT p_partkey AS id, {r('sin(x) + cos(x) * tan(x / 3e0)', 'trig')}, {r('asin(x / 60e0) + acos(x / 60e0) + atan(x) + atan2(x, 2e0)', 'arcs')}, {r('sinh(x / 20e0) + cosh(x / 20e0) + tanh(x) + asinh(x) + acosh(x + 1e0) + atanh(x / 60e0)', 'hyper')}, {r('sqrt(x) + exp(-x) + ln(x) + abs(-x) + power(x, 1.5e0)', 'plain')}, {r('floor(x / 3e0) + ceil(x / 7e0) + least(x, 20e0) + greatest(x, 30e0)', 'steps')}, {r('(x - 25e0) - 4e0 * floor((x - 25e0) / 4e0)', 'modulo')}, CASE WHEN x - 25e0 < 0 THEN 0e0 WHEN x - 25e0 = 0 THEN 0.5e0 ELSE 1e0 END AS heaviside, {r('pi() + exp(1e0) + 1e0 / 3e0', 'constants')}, CAST(factorial(CAST(x AS INT) % 12) AS BIGINT) AS factorials, x < CAST('infinity' AS DOUBLE) AND -x > CAST('-infinity' AS DOUBLE) AS finite, (x > 10e0) <> (x > 30e0) AS either FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)")
def _(spark, d):
    x = "CAST(p_size AS DOUBLE)"
    exprs = {"trig": "sin(x) + cos(x) * tan(x / 3e0)", "arcs": "asin(x / 60e0) + acos(x / 60e0) + atan(x) + atan2(x, 2e0)", "hyper": "sinh(x / 20e0) + cosh(x / 20e0) + tanh(x) + asinh(x) + acosh(x + 1e0) + atanh(x / 60e0)", "plain": "sqrt(x) + exp(-x) + ln(x) + abs(-x) + power(x, 1.5e0)", "steps": "floor(x / 3e0) + ceil(x / 7e0) + least(x, 20e0) + greatest(x, 30e0)", "constants": "pi() + e() + 1e0 / 3e0"}
    out = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(x).alias("x"))
    shifted = F.col("x") - 25.0
    return rounded(out.select("id", *(F.expr(e).cast("double").alias(n) for n, e in exprs.items()), scalars.floor_mod(shifted, F.lit(4.0)).alias("modulo"), scalars.heaviside(shifted, 0.5).alias("heaviside"), F.factorial(F.col("x").cast("int") % 12).alias("factorials"), F.expr("x < double('inf') AND -x > double('-inf')").alias("finite"), F.expr("(x > 10e0) <> (x > 30e0)").alias("either")))


@query("nearest_index", "WITH a AS (SELECT range AS i, range * 7e0 AS v FROM range(0, 9)), n AS (SELECT p_partkey AS id, i, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(v - p_size), i) AS k FROM part, a) SELECT id, i AS at FROM n WHERE k = 1")
def _(spark, d):
    axis = F.array(*(F.lit(7.0 * i) for i in range(9)))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), scalars.nearest_index(axis, F.col("p_size").cast("double")).cast("bigint").alias("at"))


# --- transforms ------------------------------------------------------------------------------------------------------------------

GRID1 = f"q AS (SELECT CAST(i AS INT) AS ih, i / 40e0 AS h, {TWO_PI} * i AS qh FROM range(-40, 41) t(i))"
GRID2 = f"q AS (SELECT CAST(a.i AS INT) AS ih, CAST(b.i AS INT) AS ik, a.i / 40e0 AS h, b.i / 50e0 AS k, {TWO_PI} * a.i AS qh, {TWO_PI} * b.i AS qk FROM range(-8, 9) a(i), range(-10, 11) b(i))"


def _ampl_sql(q: str, axes: list[tuple[str, str, str]], coeff: str, keys: str, where: str = "true") -> str:
    ph = " + ".join(f"{qa} * {x}" for qa, x, _ in axes)
    po = " + ".join(f"{qa} * {o}" for qa, _, o in axes)
    return (
        f"{q}, s AS (SELECT {keys}, sum({coeff} * cos({ph})) AS a_re, sum({coeff} * sin({ph})) AS a_im, sum(cos({po})) AS o_re, sum(sin({po})) AS o_im, "
        f"sum({coeff} * cos({ph} - ({po}))) AS d_re, sum({coeff} * sin({ph} - ({po}))) AS d_im, count(*) AS n FROM atoms, q WHERE {where} GROUP BY {keys}), "
        f"ampl AS (SELECT {keys}, a_re, a_im, (o_re * d_re - o_im * d_im) / n AS av_re, (o_re * d_im + o_im * d_re) / n AS av_im FROM s)"
    )


FOUR = ", ".join(r(x) for x in ("a_re", "a_im", "av_re", "av_im"))
AMPL1 = _ampl_sql(GRID1, [("qh", "x", "xav")], "coeff", "ih, qh")
AMPL2 = _ampl_sql(GRID2, [("qh", "x", "xav"), ("qk", "y", "yav")], "coeff", "ih, ik, qh, qk")


def grid_1d(spark, d, mask=None):
    return flows.grid_of(views.box_spec(views.atoms_2d(spark, d), 1), 1, mask)[1]


def grid_2d(spark, d, mask=None):
    return flows.grid_of(views.box_spec(views.atoms_2d(spark, d), 2, 0.2, 0.1), 2, mask)[1]


def ampl_1d(spark, d, mask=None):
    return scattering.amplitudes(views.atoms_2d(spark, d), grid_1d(spark, d, mask), ["qh"], ["x"], ["xav"], ["ih", "qh"])


def ampl_2d(spark, d, mask=None, tiled=False):
    q = grid_2d(spark, d, mask)
    if not tiled:
        return scattering.amplitudes(views.atoms_2d(spark, d), q, ["qh", "qk"], ["x", "y"], ["xav", "yav"], ["ih", "ik", "qh", "qk"])
    numbered = q.withColumn("q_id", (F.col("ih") * 4096 + F.col("ik")).cast("bigint"))
    sums = scattering.amplitudes_tiled(views.atoms_2d(spark, d), numbered, ["qh", "qk"], ["x", "y"], ["xav", "yav"], "q_id")
    return sums.join(numbered.select("q_id", "ih", "ik", "qh", "qk"), "q_id").drop("q_id")


@query("e3_forward_1d", f"{WITH2}, {AMPL1} SELECT ih, {FOUR} FROM ampl")
def _(spark, d):
    return rounded(ampl_1d(spark, d).drop("qh"))


@query("e4_average_amplitude_2d", f"{WITH2}, {AMPL2} SELECT ih, ik, {FOUR} FROM ampl")
def _(spark, d):
    return rounded(ampl_2d(spark, d).drop("qh", "qk"))


@query("d4_amplitudes_tiled", f"{WITH2}, {AMPL2} SELECT ih, ik, {FOUR} FROM ampl")
def _(spark, d):
    return rounded(ampl_2d(spark, d, tiled=True).drop("qh", "qk"))


GRID3S = f"q AS (SELECT CAST(a.i AS INT) AS ih, CAST(b.i AS INT) AS ik, CAST(c.i AS INT) AS il, {TWO_PI} * a.i AS qh, {TWO_PI} * b.i AS qk, {TWO_PI} * c.i AS ql FROM range(-1, 2) a(i), range(-1, 2) b(i), range(0, 2) c(i))"
AMPL3 = _ampl_sql(GRID3S, [("qh", "x", "xav"), ("qk", "y", "yav"), ("ql", "z", "zav")], "coeff", "ih, ik, il, qh, qk, ql")


def grid_3s(spark, d):
    return flows.grid_of(views.box_spec(views.atoms_3d(spark, d), 3, 0.05, 0.05), 3)[1]


@query("e4_average_amplitude_3d", f"{WITH3}, {AMPL3} SELECT ih, ik, il, {FOUR} FROM ampl")
def _(spark, d):
    out = scattering.amplitudes(views.atoms_3d(spark, d), grid_3s(spark, d), ["qh", "qk", "ql"], list("xyz"), ["xav", "yav", "zav"], ["ih", "ik", "il"])
    return rounded(out)


_PH, _PO = "qh * x + qk * y + ql * z", "qh * xav + qk * yav + ql * zav"


@query("e5_forward_by_element", f"{WITH3}, {GRID3S}, p AS (SELECT element AS e0, a, b, c FROM {FF_SQL} WHERE charge = 0), s AS (SELECT ih, ik, il, element, any_value(a[1] * exp(-b[1] * g) + a[2] * exp(-b[2] * g) + c) AS f, sum(cos({_PH})) AS a_re, sum(sin({_PH})) AS a_im, sum(cos({_PO})) AS o_re, sum(sin({_PO})) AS o_im, sum(cos({_PH} - ({_PO}))) AS d_re, sum(sin({_PH} - ({_PO}))) AS d_im FROM (SELECT *, (qh*qh + qk*qk + ql*ql) / power(12.566370614359172e0, 2) AS g FROM atoms, q JOIN p ON true WHERE lower(element) = e0) GROUP BY ih, ik, il, element), n AS (SELECT count(*) AS n FROM atoms) SELECT ih, ik, il, {r('sum(f * a_re)', 'a_re')}, {r('sum(f * a_im)', 'a_im')}, {r('sum(f * (o_re * d_re - o_im * d_im) / n)', 'av_re')}, {r('sum(f * (o_re * d_im + o_im * d_re) / n)', 'av_im')} FROM s, n GROUP BY ih, ik, il")
def _(spark, d):
    atoms = views.atoms_3d(spark, d).withColumn("charge", F.lit(0))
    with_params = weights.form_factor_params(atoms, views.form_factors(spark))
    norm = F.sqrt(F.col("qh") * F.col("qh") + F.col("qk") * F.col("qk") + F.col("ql") * F.col("ql"))
    f = scalars.doyle_turner(scalars.reduced(norm), F.col("a"), F.col("b"), F.col("c"))
    return rounded(scattering.amplitudes_by_element(with_params, grid_3s(spark, d), ["qh", "qk", "ql"], list("xyz"), ["xav", "yav", "zav"], ["ih", "ik", "il"], f))


@query("b11_intensity", f"{WITH2}, {AMPL1} SELECT ih, {r('a_re*a_re + a_im*a_im', 'total', 3)}, {r('power(a_re - av_re, 2) + power(a_im - av_im, 2)', 'diffuse', 3)} FROM ampl")
def _(spark, d):
    return rounded(ampl_1d(spark, d).select("ih", *scattering.intensity()), places=3)



def disc():
    return masks.mask_equation("power(pmod(h, 1.0D) - 0.5D, 2) <= power(0.25D, 2)")


DISC_SQL = "power(h - floor(h) - 0.5e0, 2) <= power(0.25e0, 2)"
FIELD1 = f"field AS (SELECT site_id, p AS px, sum((a_re - av_re) * c - (a_im - av_im) * s) AS d_re, sum((a_re - av_re) * s + (a_im - av_im) * c) AS d_im, sum(av_re * c - av_im * s) AS av_re, sum(av_re * s + av_im * c) AS av_im FROM (SELECT b.site_id, b.xav AS p, ampl.*, cos(qh * b.xav) AS c, -sin(qh * b.xav) AS s FROM atoms b, ampl) GROUP BY site_id, p)"
AMPL1M = _ampl_sql(GRID1, [("qh", "x", "xav")], "coeff", "ih, qh", DISC_SQL)
FIELD4 = ", ".join(r(x) for x in ("d_re", "d_im", "av_re", "av_im"))


def own_points(spark, d):
    return views.atoms_2d(spark, d).select("site_id", F.col("xav").alias("px"), F.lit(0).cast("bigint").alias("point_no"))


def field_1d(spark, d, mask):
    return residual.residual_field(ampl_1d(spark, d, mask), own_points(spark, d), ["qh"], ["px"], ["site_id", "point_no", "px"])


@query("e6_residual_field", f"{WITH2}, {AMPL1M}, {FIELD1} SELECT site_id, {FIELD4} FROM field")
def _(spark, d):
    return rounded(field_1d(spark, d, disc()).drop("point_no", "px"))


@query("e9_normalize_residual", f"{WITH2}, {AMPL1M}, {FIELD1} SELECT site_id, {', '.join(r(x + ' / 81e0', x) for x in ('d_re', 'd_im', 'av_re', 'av_im'))} FROM field")
def _(spark, d):
    spec = views.box_spec(views.atoms_2d(spark, d), 1)
    made = grids.make_intervals(spec, 1).crossJoin(F.broadcast(spec.select("h_size")))
    total = made.agg(F.sum(grids.count_reciprocal_points([F.col("h_size")])))
    return rounded(residual.normalize_residual(field_1d(spark, d, disc()), total).drop("point_no", "px"))


@query("e11_mirror_conjugate", f"{WITH2}, {AMPL1M}, {FIELD1} SELECT site_id, {r('2 * d_re', 'd_re')}, 0e0 AS d_im, {r('2 * av_re', 'av_re')}, 0e0 AS av_im FROM field")
def _(spark, d):
    return rounded(residual.mirror_conjugate(field_1d(spark, d, disc())).drop("point_no", "px"))


PARTS = "SELECT l_suppkey AS chunk_id, l_linenumber AS interval_id, sum(l_quantity) AS d_re, sum(l_discount) AS d_im FROM lineitem GROUP BY 1, 2"


@query("e7_merge_partials", f"WITH p AS ({PARTS}) SELECT chunk_id, {r('CAST(sum(d_re) AS DOUBLE)', 'd_re')}, {r('CAST(sum(d_im) AS DOUBLE)', 'd_im')} FROM p GROUP BY chunk_id")
def _(spark, d):
    parts = views.view(spark, d, "lineitem", PARTS).withColumns({c: F.col(c).cast("double") for c in ("d_re", "d_im")})
    twice = parts.unionByName(parts.where("interval_id < 3"))  # delivered again
    return rounded(residual.merge_partials(twice, ["chunk_id"], ["interval_id"], ["d_re", "d_im"]))


@query("d7_pending_pairs", "WITH c AS (SELECT DISTINCT o_custkey % 500 AS chunk_id, o_orderkey % 300 AS interval_id FROM orders) SELECT i.interval_id, k.chunk_id FROM (SELECT DISTINCT interval_id FROM c) i, (SELECT DISTINCT chunk_id FROM c) k WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey % 500 = k.chunk_id AND o.o_orderkey % 300 = i.interval_id AND o_orderstatus = 'F')")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 500).alias("chunk_id"), (F.col("o_orderkey") % 300).alias("interval_id"), "o_orderstatus")
    done = orders.where("o_orderstatus = 'F'").select("interval_id", "chunk_id").distinct()
    return residual.pending_pairs(orders, orders, done)


_FIELD2 = "field AS (SELECT site_id, point_no, x, y, px, py, d_re FROM (SELECT *, px * 3e0 + py AS d_re FROM patch))"
_NEAREST = "row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN abs(px - x) <= 1e-10 AND abs(py - y) <= 1e-10 THEN 0 ELSE 1 END, CASE WHEN abs(px - x) <= 1e-10 AND abs(py - y) <= 1e-10 THEN 0e0 ELSE sqrt((px - x) * (px - x) + (py - y) * (py - y)) END, point_no)"


@query("d9_centre_value", f"{WITH2}, {_PATCH}, {_FIELD2}, n AS (SELECT *, {_NEAREST} AS n FROM field) SELECT site_id, {r('d_re')} FROM n WHERE n = 1")
def _(spark, d):
    chosen = patches(spark, d)
    field = grids.patch_grid(chosen, ["x", "y"]).select("site_id", "point_no", "px", "py").withColumn("d_re", F.col("px") * 3.0 + F.col("py"))
    return rounded(residual.centre_value(field, chosen, ["x", "y"], ["px", "py"], ["d_re"]))


@query("f4_pick_centre", f"{WITH2}, {_PATCH}, {_FIELD2}, n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY d_re DESC, point_no) AS n FROM field) SELECT site_id, point_no FROM n WHERE n = 1")
def _(spark, d):
    field = grids.patch_grid(patches(spark, d), ["x", "y"]).withColumn("d_re", F.col("px") * 3.0 + F.col("py"))
    return residual.pick_centre(field, [F.desc("d_re"), F.asc("point_no")]).select("site_id", "point_no")


@query("d8_attach_site_attributes", f"{WITH2} SELECT p_partkey AS site_id, CAST(p_size AS DOUBLE) AS v, element, refnumber FROM part LEFT JOIN (SELECT * FROM atoms) a ON a.site_id = p_partkey")
def _(spark, d):
    result = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("site_id"), F.col("p_size").cast("double").alias("v"))
    return residual.attach_site_attributes(result, views.atoms_2d(spark, d))


_CENTRED = "atoms AS (SELECT site_id, element, refnumber, xav, xav AS x, coeff - avg(coeff) OVER () AS coeff FROM raw)"


@query("chemical_contrast_1d", f"WITH raw AS ({views.ATOMS_2D}), {_CENTRED}, {AMPL1M}, {FIELD1} SELECT f.site_id, a.element, a.refnumber, {r('px', 'x')}, {r('d_re / 81e0', 'intensity_re')}, {r('d_im / 81e0', 'intensity_im')} FROM field f JOIN atoms a USING (site_id)")
def chemical_contrast_1d(spark, d):
    atoms = views.atoms_2d(spark, d)
    return rounded(flows.chemical_contrast(atoms, views.box_spec(atoms, 1), 1, disc()))


@query("k16_chemical_mode", SQL["chemical_contrast_1d"])
def _(spark, d):
    """The same run by tiles."""
    atoms = views.atoms_2d(spark, d)
    return rounded(flows.chemical_contrast(atoms, views.box_spec(atoms, 1), 1, disc(), form="tiled"))


@query("h1_site_contrast_lines", f"WITH raw AS ({views.ATOMS_2D}), {_CENTRED}, {AMPL1M}, {FIELD1} SELECT f.site_id, a.element, a.refnumber, {r('px', 'x')}, {r('d_re / 81e0', 'intensity_re')} FROM field f JOIN atoms a USING (site_id) ORDER BY f.site_id")
def _(spark, d):
    return chemical_contrast_1d(spark, d).select("site_id", "element", "refnumber", "x", "intensity_re").orderBy("site_id")


# --- result files ----------------------------------------------------------------------------------------------------------------


@query("a10_contrast_lines", f"{WITH2} SELECT site_id, element, refnumber, upper(printf('%.8e', xav)) AS x, upper(printf('%.8e', yav)) AS y, '0.00000000E+00' AS z, upper(printf('%.8e', coeff)) AS intensity_re, upper(printf('%.8e', -coeff)) AS intensity_im FROM atoms")
def _(spark, d):
    rows = views.atoms_2d(spark, d).select("site_id", "element", "refnumber", F.col("xav").alias("x"), F.col("yav").alias("y"), F.col("coeff").alias("intensity_re"), (-F.col("coeff")).alias("intensity_im"))
    return tables.contrast_lines(rows)


@query("a11_displacement_lines", f"{WITH2} SELECT site_id, upper(printf('%.6e', coeff * 4e-5)) AS ux, upper(printf('%.6e', coeff / 8e0)) AS uy, 'cartesian' AS frame FROM atoms")
def _(spark, d):
    return tables.displacement_lines(views.atoms_2d(spark, d).select("site_id", (F.col("coeff") * 4e-5).alias("ux"), (F.col("coeff") / 8.0).alias("uy")))


# --- decoding --------------------------------------------------------------------------------------------------------------------


@query("k12_decoder_key", f"{WITH2} SELECT site_id, CASE WHEN site_id % 5 = 0 THEN 'central_point_id:' || site_id ELSE 'reference_number:' || refnumber END || '#2|' || printf('%.12f', coeff / 8e0) || '|0.250000000000|0.500000000000|0.125000000000|cheb|100|0.1|0.35|1' AS decoder_key FROM atoms")
def _(spark, d):
    atoms = views.atoms_2d(spark, d).select("site_id", F.when(F.col("site_id") % 5 != 0, F.col("refnumber")).alias("refnumber"), F.array(F.col("coeff") / 8.0, F.lit(0.25)).alias("dist"), F.array(F.lit(0.5), F.lit(0.125)).alias("step"))
    return atoms.select("site_id", decoder.decoder_key(decoder.patch_spec(2)).alias("decoder_key"))


@query("k13_check_patch_specs", f"{WITH2} SELECT refnumber, count(DISTINCT CAST(coeff AS INT) % 3) AS specs FROM atoms GROUP BY refnumber")
def _(spark, d):
    atoms = views.atoms_2d(spark, d).select("refnumber", F.array(F.col("coeff") % 3).alias("dist"), F.array(F.lit(0.5)).alias("step"))
    return decoder.check_patch_specs(atoms, decoder.patch_spec(1), False)


_MATRIX = f"{WITH2}, m AS (SELECT refnumber, avg(coeff) AS w1, min(coeff) AS w2, max(coeff) AS w3, count(*) AS w4 FROM atoms GROUP BY refnumber)"


@query("k11_apply_decoder_family", f"{_MATRIX} SELECT site_id, {r('x * w1 + y * w2', 'ux')}, {r('x * w3 + y * w4', 'uy')} FROM atoms JOIN m USING (refnumber)")
def _(spark, d):
    atoms = views.atoms_2d(spark, d)
    by = atoms.groupBy("refnumber").agg(F.avg("coeff").alias("w1"), F.min("coeff").alias("w2"), F.max("coeff").alias("w3"), F.count(F.lit(1)).cast("double").alias("w4"))
    rows = F.array(F.struct(F.lit(0).alias("n"), F.array("w1", "w2").alias("w")), F.struct(F.lit(1).alias("n"), F.array("w3", "w4").alias("w")))
    matrix = by.select(F.col("refnumber").cast("string").alias("decoder_key"), F.explode(rows).alias("row")).select("decoder_key", F.col("row.n").alias("row_no"), F.col("row.w").alias("weights"))
    feats = atoms.select("site_id", F.col("refnumber").cast("string").alias("decoder_key"), F.array("x", "y").alias("features"))
    return rounded(decoder.apply_decoder_family(feats, matrix, names=("ux", "uy")))


@query("k10_apply_decoder", f"{WITH2} SELECT site_id, {r('x * 2e0 + y', 'ux')}, {r('y * 3e0 - x', 'uy')} FROM atoms")
def _(spark, d):
    matrix = spark.createDataFrame([("all", 0, [2.0, 1.0]), ("all", 1, [-1.0, 3.0])], "decoder_key string, row_no int, weights array<double>")
    feats = views.atoms_2d(spark, d).select("site_id", F.array("x", "y").alias("features"))
    return rounded(decoder.apply_decoder(feats, matrix, ("ux", "uy")))


@query("d12_broadcast_displacement", f"{WITH2}, {_PATCH} SELECT p.site_id, point_no, {r('a.x - a.xav', 'ux')} FROM patch p JOIN atoms a USING (site_id)")
def _(spark, d):
    shift = views.atoms_2d(spark, d).select("site_id", (F.col("x") - F.col("xav")).alias("ux"))
    return rounded(residual_points(spark, d, shift))


def residual_points(spark, d, shift):
    return decoder.broadcast_displacement(grids.patch_grid(patches(spark, d), ["x", "y"]).select("site_id", "point_no"), shift)


@query("k14_displacements_1d")
def displacements_1d(spark, d):
    """Entry 3: train on the unmasked field, decode the masked one; checked against numpy in the tests."""
    atoms = views.atoms_2d(spark, d).where("refnumber IS NOT NULL")
    return flows.displacements(atoms, views.box_spec(atoms, 1), 1, disc(), 0.05, 0.0125, [1.0]).select("site_id", "ux")


def _ridge_sql(by: str) -> str:
    """Ridge weights of three features for two targets, by the cofactors of the three by three matrix."""
    group = f"GROUP BY {by}" if by else ""
    head = f"{by} AS decoder_key, " if by else ""
    key = "decoder_key, " if by else ""
    sums = ", ".join(f"sum({a} * {b}){' + 1e-3' if a == b else ''} AS {n}" for n, a, b in (("a", "x", "x"), ("b", "x", "y"), ("c", "x", "coeff"), ("d", "y", "y"), ("e", "y", "coeff"), ("f", "coeff", "coeff"), ("u0", "xav", "x"), ("u1", "xav", "y"), ("u2", "xav", "coeff"), ("v0", "yav", "x"), ("v1", "yav", "y"), ("v2", "yav", "coeff")))
    inverse = [["d*f - e*e", "c*e - b*f", "b*e - c*d"], ["c*e - b*f", "a*f - c*c", "b*c - a*e"], ["b*e - c*d", "b*c - a*e", "a*d - b*b"]]
    rows = " UNION ALL ".join(f"SELECT {key}{n} AS row_no, {j} AS feature, {r('(' + ' + '.join(f'{t}{i} * ({inverse[i][j]})' for i in range(3)) + ') / det', 'weight')} FROM t" for n, t in enumerate("uv") for j in range(3))
    return f"{WITH2}, s AS (SELECT {head}{sums} FROM atoms {group}), t AS (SELECT *, a * (d*f - e*e) - b * (b*f - c*e) + c * (b*e - c*d) AS det FROM s) {rows}"


@query("e13_train_decoder", _ridge_sql(""))
def _(spark, d):
    """Decoder matrix of all sites."""
    atoms = views.atoms_2d(spark, d)
    at = atoms.select("site_id", F.array("x", "y", "coeff").alias("features"), F.array("xav", "yav").alias("target"))
    return rounded(decoder.train_decoder(at).select("row_no", F.posexplode("weights").alias("feature", "weight")))


@query("e14_train_decoder_family", _ridge_sql("CAST(refnumber AS VARCHAR)"))
def _(spark, d):
    atoms = views.atoms_2d(spark, d)
    at = atoms.select(F.col("refnumber").cast("string").alias("decoder_key"), F.array("x", "y", "coeff").alias("features"), F.array("xav", "yav").alias("target"))
    return rounded(decoder.train_decoder_family(at).select("decoder_key", "row_no", F.posexplode("weights").alias("feature", "weight")))


@query("e14_conjugate_gradients", _ridge_sql("CAST(refnumber AS VARCHAR)"))
def _(spark, d):
    """The same matrices without any square of the features, as for patches of many thousand points."""
    atoms = views.atoms_2d(spark, d)
    at = atoms.select(F.col("refnumber").cast("string").alias("key"), F.array("x", "y", "coeff").alias("features"), F.array("xav", "yav").alias("target"))
    out = decoder.conjugate_ridge(at).select(F.col("key").alias("decoder_key"), "row_no", F.posexplode("weights").alias("feature", "weight"))
    return rounded(out)


@query("k9_patch_features")
def _(spark, d):
    """Features of each site's patch; checked against numpy in the tests."""
    atoms = views.atoms_2d(spark, d)
    at = atoms.select("site_id", F.col("xav").alias("x"), F.array(F.lit(0.05)).alias("dist"), F.array(F.lit(0.0125)).alias("step"))
    field = flows.transform(atoms, at, views.box_spec(atoms, 1), 1, disc(), ["x"], ["xav"])
    made = features.patch_features(field, at, ["x"], ["px"], [1.0])
    return made.select("site_id", F.posexplode("features").alias("feature", "value"))


# --- analyses --------------------------------------------------------------------------------------------------------------------


@query("e15_distinct_elements", f"{WITH2} SELECT element, count(*) AS atoms, list_sort(list(DISTINCT refnumber)) AS refnumbers FROM atoms GROUP BY element")
def _(spark, d):
    return analysis.distinct_elements(views.atoms_2d(spark, d))


@query("e16_rms", f"{WITH2} SELECT element, {r('sqrt(avg(x * x + y * y))', 'rms')} FROM atoms GROUP BY element")
def _(spark, d):
    return rounded(views.atoms_2d(spark, d).groupBy("element").agg(analysis.rms(F.col("x"), F.col("y")).alias("rms")))


LATTICE2 = "lat AS (SELECT cell_x AS gx, cell_y AS gy, avg(coeff) - 25.5e0 AS v, CASE WHEN CAST(sum(coeff) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM atoms GROUP BY cell_x, cell_y)"
NEIGH2 = "o AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(dx, dy)), pairs AS (SELECT a.gx, a.gy, a.gx * 100 + a.gy AS centre, a.kind, a.v, b.v AS n_v, b.kind AS n_kind FROM lat a, o JOIN lat b ON true WHERE b.gx = (a.gx + dx + 40) % 40 AND b.gy = (a.gy + dy + 50) % 50)"


def lattice_2d(spark, d):
    atoms = views.atoms_2d(spark, d)
    return atoms.groupBy(F.col("cell_x").alias("gx"), F.col("cell_y").alias("gy")).agg((F.avg("coeff") - 25.5).alias("v"), F.when(F.sum("coeff").cast("bigint") % 2 == 0, "even").otherwise("odd").alias("kind"))


def pairs_2d(spark, d):
    out = analysis.periodic_neighbours(lattice_2d(spark, d), ["gx", "gy"], [40, 50], analysis.FOUR, ["v", "kind"])
    return out.withColumn("centre", F.col("gx") * 100 + F.col("gy"))


@query("d10_periodic_neighbours", f"{WITH2}, {LATTICE2}, {NEIGH2} SELECT gx, gy, count(*) AS neighbours, {r('sum(n_v)', 'total')} FROM pairs GROUP BY gx, gy")
def _(spark, d):
    return rounded(pairs_2d(spark, d).groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("neighbours"), F.sum("n_v").alias("total")))


@query("e17_coordination_histogram", f"{WITH2}, {LATTICE2}, {NEIGH2}, e AS (SELECT centre, kind, CAST(sum(CASE WHEN n_kind = 'even' THEN 1 ELSE 0 END) AS BIGINT) AS split FROM pairs GROUP BY centre, kind), c AS (SELECT kind, split, count(*) AS centres FROM e GROUP BY kind, split) SELECT kind, split, centres, {r('100e0 * centres / sum(centres) OVER (PARTITION BY kind)', 'percent')} FROM c")
def _(spark, d):
    return rounded(analysis.coordination_histogram(pairs_2d(spark, d), "centre", "kind", "n_kind", "even"))


@query("e18_stats_by_element", f"{WITH2} SELECT element, count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END)', 'above')}, {r('avg(CASE WHEN v < 0 THEN 1e0 ELSE 0e0 END)', 'below')}, {r('avg(CASE WHEN sign(v) = sign(x - xav) THEN 1e0 ELSE 0e0 END)', 'accuracy')} FROM (SELECT *, coeff - 20e0 AS v FROM atoms) GROUP BY element")
def _(spark, d):
    atoms = views.atoms_2d(spark, d).withColumn("v", F.col("coeff") - 20.0)
    return rounded(analysis.stats_by_element(atoms, "v", sign=F.signum(F.col("x") - F.col("xav"))))


@query("e19_sign_coordination", f"{WITH2}, {LATTICE2}, {NEIGH2} SELECT centre, {', '.join(f'CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}' for c, n in (('n_v > 0', 'positive'), ('n_v < 0', 'negative'), ('t > 0', 'true_positive'), ('t < 0', 'true_negative')))} FROM (SELECT *, n_v - v AS t FROM pairs) GROUP BY centre HAVING count(n_v) = 4")
def _(spark, d):
    return analysis.sign_coordination(pairs_2d(spark, d).withColumn("t", F.col("n_v") - F.col("v")), "centre", "n_v", "t", 4)


@query("e20_mean_by_coordination", f"{WITH2}, {LATTICE2}, {NEIGH2}, e AS (SELECT centre, avg(n_v) AS m, CAST(sum(CASE WHEN n_kind = 'even' THEN 1 ELSE 0 END) AS BIGINT) AS split FROM pairs GROUP BY centre) SELECT split, count(*) AS centres, {r('avg(m)', 'mean')}, {r('stddev_pop(m)', 'std')} FROM e GROUP BY split")
def _(spark, d):
    return rounded(analysis.mean_by_coordination(pairs_2d(spark, d), "centre", "n_v", F.when(F.col("n_kind") == "even", 1).otherwise(0)))


@query("l7_coordination_3d", f"{WITH3}, g AS (SELECT CAST(round_even(x * 20e0, 0) AS INT) % 20 AS gx, CAST(round_even(y * 20e0, 0) AS INT) % 20 AS gy, CAST(round_even(z * 20e0, 0) AS INT) % 20 AS gz, avg(coeff) AS v FROM atoms GROUP BY 1, 2, 3), o AS (SELECT * FROM (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) AS t(dx, dy, dz)) SELECT a.gx, a.gy, a.gz, count(*) AS neighbours, {r('avg(b.v)', 'mean')} FROM g a, o, g b WHERE b.gx = (a.gx + dx + 20) % 20 AND b.gy = (a.gy + dy + 20) % 20 AND b.gz = (a.gz + dz + 20) % 20 GROUP BY 1, 2, 3")
def _(spark, d):
    placed = analysis.site_grid(views.atoms_3d(spark, d), list("xyz"), [0.1] * 3, [20] * 3, ["gx", "gy", "gz"])
    cells_of = placed.groupBy("gx", "gy", "gz").agg(F.avg("coeff").alias("v"))
    out = analysis.periodic_neighbours(cells_of, ["gx", "gy", "gz"], [20] * 3, analysis.SIX, ["v"])
    return rounded(out.groupBy("gx", "gy", "gz").agg(F.count(F.lit(1)).alias("neighbours"), F.avg("n_v").alias("mean")))


@query("l6_site_grid", f"{WITH3} SELECT site_id, CAST(round_even(x * 20e0, 0) AS INT) % 20 AS gx, CAST(round_even(y * 20e0, 0) AS INT) % 20 AS gy FROM atoms WHERE x >= 0 AND y >= 0")
def _(spark, d):
    atoms = views.atoms_3d(spark, d).where("x >= 0 AND y >= 0")
    return analysis.site_grid(atoms, ["x", "y"], [0.1, 0.1], [20, 20], ["gx", "gy"]).select("site_id", "gx", "gy")


@query("e22_intensity_percentiles", f"{WITH2} SELECT element, {r('quantile_cont(v, 0.01) FILTER (WHERE v > 0)', 'p0')}, {r('quantile_cont(v, 0.995) FILTER (WHERE v > 0)', 'p1')} FROM (SELECT *, coeff - 10e0 AS v FROM atoms) GROUP BY element")
def _(spark, d):
    values_of = views.atoms_2d(spark, d).select("element", (F.col("coeff") - 10.0).alias("v"))
    elements = values_of.select("element").distinct()
    found = analysis.intensity_percentiles(values_of, ["element"], "v")
    return rounded(elements.join(found, "element", "left").select("element", "p0", "p1"))


@query("l1_intensity_map", f"{WITH2}, n AS (SELECT cell_x AS ih, cell_y AS ik, coeff, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY site_id DESC) AS n FROM atoms) SELECT ih, ik, coeff FROM n WHERE n = 1")
def _(spark, d):
    return analysis.intensity_map(views.atoms_2d(spark, d).select(F.col("cell_x").alias("ih"), F.col("cell_y").alias("ik"), "coeff", "site_id"), "coeff", "site_id")


@query("l3_staggered_order", f"{WITH2}, {LATTICE2} SELECT gx, gy, {r('CASE WHEN (gx + gy) % 2 = 0 THEN v ELSE -v END', 'order_value')} FROM lat")
def _(spark, d):
    return rounded(lattice_2d(spark, d).select("gx", "gy", analysis.staggered_order("gx", "gy", "v").alias("order_value")))


_WEIGHTS = values([(o, w) for o, w in analysis.gaussian(1.0)], "o, w")
SMOOTH = f"w AS {_WEIGHTS}, s1 AS (SELECT (gx + o + 40) % 40 AS gx, gy, sum(v * w) AS v FROM lat, w GROUP BY 1, 2), smooth AS (SELECT gx, (gy + o + 50) % 50 AS gy, sum(v * w) AS v FROM s1, w GROUP BY 1, 2)"


def smooth_2d(spark, d):
    return analysis.periodic_smooth(lattice_2d(spark, d), ["gx", "gy"], [40, 50], "v")


@query("l4_periodic_smooth", f"{WITH2}, {LATTICE2}, {SMOOTH} SELECT gx, gy, {r('v')} FROM smooth")
def _(spark, d):
    return rounded(smooth_2d(spark, d))


@query("l5_domain_boundaries", f"{WITH2}, {LATTICE2}, {SMOOTH} SELECT a.gx, a.gy, b.gx AS n_gx, b.gy AS n_gy FROM smooth a, (VALUES (1, 0), (0, 1)) AS t(dx, dy), smooth b WHERE b.gx = (a.gx + dx) % 40 AND b.gy = (a.gy + dy) % 50 AND sign(a.v) <> sign(b.v)")
def _(spark, d):
    return analysis.domain_boundaries(smooth_2d(spark, d), ["gx", "gy"], [40, 50], "v").select("gx", "gy", "n_gx", "n_gy")


@query("d11_join_runs", f"{WITH2} SELECT site_id, {r('x')} , {r('y')} FROM atoms WHERE false")
def _(spark, d):
    one, two = (field_1d(spark, d, m).withColumnsRenamed({"d_re": "re", "d_im": "im"}) for m in (disc(), ~disc()))
    return rounded(analysis.join_runs(one, two, "site_id", ["re", "im"], ("disc", "rest")))


def _field_where(name: str, where: str) -> str:
    return f"{name} AS (SELECT b.site_id, sum((a_re - av_re) * cos(qh * xav) + (a_im - av_im) * sin(qh * xav)) AS re, sum((a_im - av_im) * cos(qh * xav) - (a_re - av_re) * sin(qh * xav)) AS im FROM atoms b, (SELECT ampl.*, ih / 40e0 AS h FROM ampl) WHERE {where} GROUP BY b.site_id)"


SQL["d11_join_runs"] = f"{WITH2}, {AMPL1}, {_field_where('one', DISC_SQL)}, {_field_where('two', f'NOT ({DISC_SQL})')} SELECT site_id, {r('one.re', 'disc_re')}, {r('one.im', 'disc_im')}, {r('two.re', 'rest_re')}, {r('two.im', 'rest_im')} FROM one JOIN two USING (site_id)"


@query("l8_linearity_check", f"{WITH2}, {AMPL1}, {_field_where('alls', 'true')} SELECT 0e0 AS rms, {r('sqrt(avg(re * re + im * im))', 'rms_all')}, 0e0 AS relative FROM alls")
def _(spark, d):
    whole = field_1d(spark, d, None).withColumnsRenamed({"d_re": "re", "d_im": "im"})
    parts = [field_1d(spark, d, m).withColumnsRenamed({"d_re": "re", "d_im": "im"}) for m in (disc(), ~disc())]
    return rounded(analysis.linearity_check(parts[0].unionByName(parts[1]), whole, "site_id"))


@query("h2_first_training_rows", f"{WITH2} SELECT site_id, refnumber FROM atoms ORDER BY refnumber, site_id LIMIT 500")
def _(spark, d):
    """The first rows for training are the feature here."""
    return views.atoms_2d(spark, d).select("site_id", "refnumber").orderBy("refnumber", "site_id").limit(500)


@query("h3_lattice_order", f"{WITH2} SELECT site_id, dense_rank() OVER (ORDER BY xav) - 1 AS gx, dense_rank() OVER (ORDER BY yav) - 1 AS gy FROM atoms")
def _(spark, d):
    out = analysis.lattice_order(views.atoms_2d(spark, d).select("site_id", "xav", "yav"), "xav", "yav")
    return out.select("site_id", F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy"))


@query("complex_functions", f"{WITH2} SELECT site_id, {r('x * xav - y * yav', 'm_re', 9)}, {r('x * yav + y * xav', 'm_im', 9)}, {r('x * x + y * y', 'square', 9)} FROM atoms")
def _(spark, d):
    a, b = (F.col("x"), F.col("y")), (F.col("xav"), F.col("yav"))
    m = C.multiply(a, b)
    return rounded(views.atoms_2d(spark, d).select("site_id", m[0].alias("m_re"), m[1].alias("m_im"), C.abs2(C.conjugate(a)).alias("square")), places=9)


# --- inverse transform in two and three dimensions --------------------------------------------------------------------------------

FIELD2 = f"field AS (SELECT b.site_id, sum((a_re - av_re) * c - (a_im - av_im) * s) AS d_re, sum((a_re - av_re) * s + (a_im - av_im) * c) AS d_im, sum(av_re * c - av_im * s) AS av_re, sum(av_re * s + av_im * c) AS av_im FROM (SELECT b.site_id, ampl.*, cos(qh * b.xav + qk * b.yav) AS c, -sin(qh * b.xav + qk * b.yav) AS s FROM atoms b, ampl) b GROUP BY b.site_id)"
FIELD3 = f"field AS (SELECT b.cell_x, b.cell_y, sum((a_re - av_re) * c - (a_im - av_im) * s) AS d_re, sum((a_re - av_re) * s + (a_im - av_im) * c) AS d_im, sum(av_re * c - av_im * s) AS av_re, sum(av_re * s + av_im * c) AS av_im FROM (SELECT p.cell_x, p.cell_y, ampl.*, cos(qh * p.x + qk * p.y + ql * p.z) AS c, -sin(qh * p.x + qk * p.y + ql * p.z) AS s FROM (SELECT cell_x, cell_y, cell_x / 20e0 AS x, cell_y / 20e0 AS y, 5e-1 AS z FROM (SELECT DISTINCT cell_x, cell_y FROM atoms)) p, ampl) b GROUP BY b.cell_x, b.cell_y)"


@query("e6_residual_field_2d_tiled", f"{WITH2}, {AMPL2}, {FIELD2} SELECT site_id, {FIELD4} FROM field")
def _(spark, d):
    points = views.atoms_2d(spark, d).select("site_id", F.col("xav").alias("px"), F.col("yav").alias("py"))
    return rounded(residual.residual_field_tiled(ampl_2d(spark, d, tiled=True), points, ["qh", "qk"], ["px", "py"], ["site_id"]))


@query("e6_residual_field_3d_tiled", f"{WITH3}, {AMPL3}, {FIELD3} SELECT cell_x, cell_y, {', '.join(r(x, places=5) for x in ('d_re', 'd_im', 'av_re', 'av_im'))} FROM field")
def _(spark, d):
    atoms, q = views.atoms_3d(spark, d), grid_3s(spark, d)
    number = ((F.col("ih") * 4096 + F.col("ik")) * 4096 + F.col("il")).cast("bigint")
    q = q.withColumn("q_id", number)
    ampl = scattering.amplitudes_tiled(atoms, q, ["qh", "qk", "ql"], list("xyz"), ["xav", "yav", "zav"], "q_id").join(q.select("q_id", "qh", "qk", "ql"), "q_id")
    points = atoms.select("cell_x", "cell_y").distinct().select("cell_x", "cell_y", (F.col("cell_x") / 20).alias("px"), (F.col("cell_y") / 20).alias("py"), F.lit(0.5).alias("pz"))
    return rounded(residual.residual_field_tiled(ampl, points, ["qh", "qk", "ql"], ["px", "py", "pz"], ["cell_x", "cell_y"]), places=5)


@query("k14_displacements_2d")
def displacements_2d(spark, d):
    """All sites in two dimensions, decoded from a masked field by matrices of the whole one; checked against numpy in the tests."""
    atoms = views.atoms_2d(spark, d)
    spec = views.box_spec(atoms, 2, 0.2, 0.2)
    return flows.displacements(atoms, spec, 2, masks.mask_equation("abs(h) + abs(k) > 0.1D"), 0.05, 0.0125, [1.0, 1.0]).select("site_id", "ux", "uy")


# --- files and stored tables -------------------------------------------------------------------------------------------------------


def _cells(*columns: str, between: str = "\t") -> Column:
    return F.concat_ws(between, *(F.col(c).cast("string") for c in columns))


@query("a1_read_structure_1d", f"{WITH2} SELECT row_number() OVER (PARTITION BY coeff ORDER BY site_id) - 1 AS site_id, element, refnumber, {r('x * 8e0', 'x')}, {r('xav * 8e0', 'xav')}, coeff FROM atoms")
def _(spark, d):
    path, atoms = tables.scratch(spark), views.atoms_2d(spark, d).withColumn("structure", F.col("coeff"))
    tables.write_files(atoms, "structure", "site_id", ["Supercell dimensions:\t40", "Cell (Ang/deg):\t8.0", "Element\tX\tXav\tRefNumber\tCoeff"], _cells("element", "x", "xav", "refnumber", "coeff"), path)
    return rounded(structures.read_structure_1d(spark, path).select("site_id", "element", "refnumber", "x", "xav", "coeff"))


@query("a2_read_structure_2d", f"{WITH2} SELECT row_number() OVER (PARTITION BY coeff ORDER BY site_id) - 1 AS site_id, element, refnumber, {r('x * 8e0 + y * 10e0 * cos(radians(6e1))', 'x')}, {r('y * 10e0 * sin(radians(6e1))', 'y')}, {r('xav * 8e0 + yav * 10e0 * cos(radians(6e1))', 'xav')}, {r('yav * 10e0 * sin(radians(6e1))', 'yav')}, coeff FROM atoms")
def _(spark, d):
    path, atoms = tables.scratch(spark), views.atoms_2d(spark, d).withColumn("structure", F.col("coeff"))
    tables.write_files(atoms, "structure", "site_id", ["Supercell dimensions: 40 50", "Cell (Ang/deg): 8.0 10.0 60.0", "Element X Y Xav Yav RefNumber FF"], _cells("element", "x", "y", "xav", "yav", "refnumber", "coeff", between=" "), path)
    return rounded(structures.read_structure_2d(spark, path).select("site_id", "element", "refnumber", "x", "y", "xav", "yav", "coeff"))


@query("a3_read_structure_rmc6f", f"{WITH3} SELECT site_id, element, {r('x')}, {r('y')}, {r('z')}, refnumber, cell_x, cell_y, cell_z FROM atoms")
def _(spark, d):
    path, atoms = tables.scratch(spark), views.atoms_3d(spark, d).withColumns({"structure": F.col("cell_x"), "label": F.lit("[1]")})
    tables.write_files(atoms, "structure", "site_id", ["Supercell dimensions: 20 20 20", "Cell (Ang/deg): 8 8 8 90 90 90", "Atoms:"], _cells("site_id", "element", "label", "x", "y", "z", "refnumber", "cell_x", "cell_y", "cell_z", between=" "), path)
    return rounded(structures.read_structure_rmc6f(spark, path).select("site_id", "element", "x", "y", "z", "refnumber", "cell_x", "cell_y", "cell_z"))


@query("a4_read_points", f"{WITH3} SELECT row_number() OVER (PARTITION BY cell_x ORDER BY site_id) - 1 AS point_no, {r('x')}, {r('y')}, {r('z')} FROM atoms")
def _(spark, d):
    path, atoms = tables.scratch(spark), views.atoms_3d(spark, d)
    tables.write_files(atoms, "cell_x", "site_id", [], _cells("x", "y", "z", between=" "), path)
    return rounded(structures.read_points(spark, path, 3).select("point_no", *(F.col("p")[i].alias(a) for i, a in enumerate("xyz"))))


@query("a8_stored_amplitudes", f"{WITH2}, {AMPL1} SELECT ih, {FOUR}, CAST(abs(ih) % 4 AS INT) AS interval_id FROM ampl WHERE abs(ih) % 4 IN (1, 2)")
def _(spark, d):
    path = tables.scratch(spark)
    tables.write_amplitudes(ampl_1d(spark, d).withColumn("interval_id", (F.abs("ih") % 4).cast("int")), path)
    return rounded(tables.read_amplitudes(spark, path, [1, 2]).select("ih", "a_re", "a_im", "av_re", "av_im", "interval_id"))


@query("a9_stored_residual", f"{WITH2}, {AMPL1M}, {FIELD1} SELECT site_id, {r('d_re')}, {r('d_im')}, CAST(site_id % 5 AS INT) AS chunk_id, 81 AS points FROM field")
def _(spark, d):
    path = tables.scratch(spark)
    field = field_1d(spark, d, disc()).withColumn("chunk_id", (F.col("site_id") % 5).cast("int"))
    tables.write_residual(field, spark.createDataFrame([(1, c, 81) for c in range(5)], "interval_id int, chunk_id int, points int"), path)
    values_of, applied = tables.read_residual(spark, path)
    return rounded(values_of.join(F.broadcast(applied), "chunk_id").select("site_id", "d_re", "d_im", "chunk_id", "points"))


@query("a12_stored_sites", "SELECT p_partkey AS site_id, CASE WHEN p_size <= 25 THEN 'first' ELSE 'second' END AS origin FROM part")
def _(spark, d):
    path, part = tables.scratch(spark), spark.read.parquet(f"{d}/part.parquet")
    tables.write_sites(part.where("p_size <= 25").select(F.col("p_partkey").alias("site_id"), F.lit("first").alias("origin")), path)
    tables.write_sites(part.select(F.col("p_partkey").alias("site_id"), F.lit("second").alias("origin")), path)
    return spark.read.parquet(path)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: chemical contrast of all sites of the lattice in one dimension."""
    return chemical_contrast_1d(spark, sf_dir)
