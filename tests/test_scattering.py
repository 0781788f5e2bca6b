"""Literal fixtures, numpy brute force and invariants of the scattering operators."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfield.functions import lattice, scalars
from quartzfield.operators import decoder, features, grids, masks, ranges, residual, scattering, sites, weights
from quartzfield.plans import flows, views
from quartzfield.sources import structures, tables
from quartzfield.streaming import partials

DATA = "/root/testdata/sf0.001"


def test_equation_mask(spark):
    q = spark.createDataFrame([(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0)], "h double, k double, l double")
    assert [r.h for r in q.where(masks.mask_equation("h > 0")).collect()] == [1.0]


@pytest.mark.parametrize("axes,points,centre,radius,inside", [(["h"], [(0.0, 0.0), (0.2, 0.0), (1.5, 0.0)], (0.0, 0.0), 0.3, [0.0, 0.2]), (["h", "k"], [(0.0, 0.0), (0.4, 0.0), (0.9, 0.9)], (0.0, 0.0), 0.5, [0.0, 0.4])])
def test_periodic_masks(spark, axes, points, centre, radius, inside):
    q = spark.createDataFrame([(*p, 0.0) for p in points], "h double, k double, l double")
    special = spark.createDataFrame([(*centre, 0.0, radius)], "c_h double, c_k double, c_l double, radius double")
    got = {r.h for r in masks.mask_periodic(q, special, axes).collect()}
    assert set(inside) <= got


def test_candidates_hold_the_point(spark):
    df = spark.createDataFrame([(-1.0, 1.0, 0.25)], "low double, high double, a double")
    assert 0.25 in {r.candidate for r in masks.periodic_candidates(df, "a", "low", "high").collect()}


def test_lattice_products(spark):
    two = lattice.apply_lattice(spark.createDataFrame([(1.0, 2.0), (0.5, 0.25)], "x double, y double"), [[2, 0], [0.5, 3]], ["x", "y"])
    assert [tuple(r) for r in two.collect()] == [(3.0, 6.0), (1.125, 0.75)]
    three = lattice.apply_lattice(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"), [[1, 0, 0], [0.5, 2, 0], [0.25, 0.75, 3]], ["x", "y", "z"])
    assert tuple(three.first()) == (2.75, 6.25, 9.0)
    with pytest.raises(ValueError):
        lattice.apply_lattice(two, [[1.0]], ["x", "y"])


def test_elements_and_unknown_element(spark):
    table = spark.createDataFrame([("na", 11.0, 0.363), ("cl", 17.0, 0.9577)], "element string, z double, b double")
    atoms = spark.createDataFrame([(0, " Na+ "), (1, "CL")], "site_id int, element string")
    got = weights.assign_coefficients(weights.assign_coefficients(atoms, "atomic_number", table, out="z1"), "neutron", table, out="b1").orderBy("site_id").collect()
    assert [(r.z1, r.b1) for r in got] == [(11.0, 0.363), (17.0, 0.9577)]
    with pytest.raises(Exception, match="unknown element"):
        weights.assign_coefficients(spark.createDataFrame([("Xx",)], "element string"), "neutron", table).collect()
    with pytest.raises(ValueError):
        weights.assign_coefficients(atoms, "xray")


def test_centring(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (3, 2, 10.0), (4, 2, 14.0)], "site_id int, refnumber int, coeff double")
    got = [r.coeff for r in weights.center_coefficients(df, "refnumber").orderBy("site_id").collect()]
    assert got == [-0.5, 0.5, -2.0, 2.0]
    with pytest.raises(ValueError):
        weights.center_coefficients(df, "other")


def test_matrix_map(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "i int, j int, value double")
    atoms = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.5)], "site_id int, xav double, yav double")
    assert [r.matrix_value for r in weights.map_matrix(atoms, m, 2, 2).orderBy("site_id").collect()] == [1.0, 4.0]


def test_partials(spark):
    rows = [(101, 1, 1.0, 1.0, 0.5, 0.0), (102, 1, 2.0, 0.0, 0.25, 0.0)]
    df = spark.createDataFrame(rows + rows[:1], "interval_id int, p int, d_re double, d_im double, av_re double, av_im double")
    got = residual.merge_partials(df, ["p"], ["interval_id"], ["d_re", "d_im", "av_re", "av_im"]).first()
    assert tuple(got) == (1, 3.0, 1.0, 0.75, 0.0)
    mirrored = residual.mirror_conjugate(df.withColumn("n", F.lit(5)), "n").first()
    assert (mirrored.d_re, mirrored.d_im, mirrored.av_re, mirrored.n) == (2.0, 0.0, 1.0, 10)
    with pytest.raises(Exception, match="twice"):
        residual.merge_partials(df, ["p"], ["interval_id"], ["d_re"], refuse=True).collect()
    scaled = residual.normalize_residual(df, spark.createDataFrame([(2,)], "n int")).first()
    assert scaled.d_re == 0.5


def test_counts(spark):
    spec = spark.createDataFrame([(1, 1.0, 1.0, 40.0)], "spec_id int, h_limit double, h_step double, h_size double")
    made = grids.make_intervals(spec, 1)
    assert sorted((r.h_start, r.h_end) for r in made.collect()) == [(-1.0, -0.025), (0.0, 1.0)]
    assert grids.q_grid(made, [40]).count() == 81
    names = [f"{a}_{n}" for a in "hk" for n in ("limit", "step", "size")]
    two = spark.createDataFrame([(1, 40.0, 5.0, 40.0, 40.0, 5.0, 40.0)], "spec_id int, " + ", ".join(f"{n} double" for n in names))
    got = grids.make_intervals(two, 2)
    assert (got.count(), got.agg(F.sum(grids.count_reciprocal_points([40, 40]))).first()[0]) == (256, 10_246_401)
    names = [f"{a}_{n}" for a in "hkl" for n in ("limit", "step", "size")]
    three = spark.createDataFrame([(1, *[20.0, 5.0, 20.0] * 3)], "spec_id int, " + ", ".join(f"{n} double" for n in names))
    got = grids.make_intervals(three, 3)
    assert (got.count(), got.agg(F.sum(grids.count_reciprocal_points([20, 20, 20]))).first()[0]) == (320, 513_922_401)


def test_patch_of_one_point(spark):
    s = spark.createDataFrame([(7, 0.5, [0.01], [0.05])], "site_id int, x double, dist array<double>, step array<double>")
    assert [(r.px, r.point_no) for r in grids.patch_grid(s, ["x"]).collect()] == [(0.5, 0)]
    wide = spark.createDataFrame([(7, 0.5, [0.1], [0.04])], "site_id int, x double, dist array<double>, step array<double>")
    assert np.allclose([r.px for r in grids.patch_grid(wide, ["x"]).orderBy("point_no").collect()], 0.5 + np.arange(-0.1, 0.1 + 0.04 - 1e-8, 0.04))


def test_tiles_equal_columns(spark):
    rng = np.random.default_rng(3)
    r, c = rng.random((50, 2)), rng.normal(size=50)
    o = np.round(r * 4) / 4
    atoms = spark.createDataFrame([(*map(float, a), *map(float, b), float(x)) for a, b, x in zip(r, o, c, strict=True)], "x double, y double, ox double, oy double, coeff double")
    q = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(20)], "q_id bigint, qx double, qy double")
    args = ["qx", "qy"], ["x", "y"], ["ox", "oy"]
    one = scattering.amplitudes(atoms, q, *args, ["q_id"]).orderBy("q_id").toPandas().to_numpy()
    two = scattering.amplitudes_tiled(atoms, q, *args, "q_id", atom_rows=7, q_rows=6).orderBy("q_id").toPandas().to_numpy()
    k = np.array([(i % 5, i // 5) for i in range(20)], float)
    full, origin = np.exp(1j * k @ r.T), np.exp(1j * k @ o.T)
    a, av = full @ c, origin.sum(1) * ((full * origin.conj()) @ c) / 50
    want = np.stack([np.arange(20), a.real, a.imag, av.real, av.imag], 1)
    assert np.allclose(one, want) and np.allclose(two, want)


def test_window_and_kernel():
    w = features.chebyshev_window(33)
    assert len(w) == 33 and abs(w.max() - 1) < 1e-12 and np.allclose(w[1:], w[1:][::-1])
    side = np.abs(np.fft.fft(features.chebyshev_window(64), 8192))
    side = side / side.max()
    assert side[8192 // 8 : 8192 // 2].max() < 5e-5  # 100 dB down but for the dropped point
    k = features.psf((9, 11), (2.0, 2.0))
    assert k.shape == (9, 11) and abs(k.sum() - 1) < 1e-12
    y = np.random.default_rng(0).random((6, 5))
    want = np.zeros_like(y)
    ker = np.random.default_rng(1).random((3, 3))
    for i in range(6):
        for j in range(5):
            want[i, j] = sum(y[i - a + 1, j - b + 1] * ker[a, b] for a in range(3) for b in range(3) if 0 <= i - a + 1 < 6 and 0 <= j - b + 1 < 5)
    assert np.allclose(features.filter_patch(y, ker), want)
    assert np.array_equal(features.band_taper(4, 4, 0.0), np.ones(4)) and features.band_taper(8, 8, 2.0)[0] == 1


def test_regrid_and_centre():
    coords = np.array([(a, b) for a in (0.0, 1.0, 2.0) for b in (0.0, 1.0, 2.0)])
    grid, axes = features.regrid_patch(coords, np.arange(9.0))
    assert np.array_equal(grid, np.arange(9.0).reshape(3, 3))
    assert np.allclose(features.centre_patch(grid, axes, (1.0, 1.0)), grid)


def test_family_decoder(spark):
    rows = [("a", [1.0], [1.0]), ("a", [2.0], [2.0]), ("b", [1.0, 0.0], [10.0]), ("b", [0.0, 1.0], [20.0])]
    m = decoder.train_decoder_family(spark.createDataFrame(rows, "decoder_key string, features array<double>, target array<double>"), lam=1e-9)
    asked = spark.createDataFrame([(1, "a", [3.0]), (2, "b", [0.0, 4.0]), (3, "a", [5.0])], "site_id bigint, decoder_key string, features array<double>")
    got = decoder.apply_decoder_family(asked, m, names=("ux",)).orderBy("site_id").collect()
    assert np.allclose([r.ux for r in got], [3, 80, 5], atol=1e-6)
    with pytest.raises(Exception, match="no decoder"):
        decoder.apply_decoder_family(spark.createDataFrame([(1, "c", [3.0])], asked.schema), m, names=("ux",)).collect()
    with pytest.raises(ValueError):
        decoder.decoder_source("error", None, {}, lambda: m)


def test_primal_and_dual_agree():
    rng = np.random.default_rng(2)
    r, u = rng.normal(size=(6, 20)), rng.normal(size=(2, 20))
    assert np.allclose(decoder.solve_ridge(r @ r.T, u @ r.T, 1e-3), decoder.solve_dual(r, u, 1e-3))


def test_decoder_cache(spark, tmp_path):
    made = spark.createDataFrame([("all", 0, [1.0, 2.0])], "decoder_key string, row_no int, weights array<double>")
    decoder.decoder_source("compute", str(tmp_path), {"step": 0.1}, lambda: made, spark)
    assert decoder.decoder_source("cache", str(tmp_path), {"step": 0.1}, None, spark).first().weights == [1.0, 2.0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        decoder.decoder_source("cache", str(tmp_path), {"step": 0.2}, None, spark)


def test_intervals_of_small_steps_leave_out_points(spark):
    points = {step: flows.grid_of(views.box_spec(spark.range(1), 1, 1.0, step, (4,)), 1)[1].count() for step in (1.0, 0.5, 0.1)}
    assert points[1.0] == points[0.5] == 9 and points[0.1] < 9


def test_patch_conflict(spark):
    s = spark.createDataFrame([(1, [0.2], [0.1]), (1, [0.3], [0.1])], "refnumber int, dist array<double>, step array<double>")
    assert decoder.check_patch_specs(s, decoder.patch_spec(1), False).first().specs == 2
    with pytest.raises(Exception, match="different patches"):
        decoder.check_patch_specs(s, decoder.patch_spec(1), True).collect()


def test_displacements_recover(spark):
    """A decoder trained on the unmasked field gives the known displacements back."""
    rng = np.random.default_rng(4)
    n = 16
    u = rng.uniform(-2e-3, 2e-3, n)
    atoms = spark.createDataFrame([(i, "A", 1, i, 1.0, i / n, float(i / n + u[i])) for i in range(n)], "site_id bigint, element string, refnumber int, cell_x int, coeff double, xav double, x double")
    got = flows.displacements(atoms, views.box_spec(atoms, 1, 8.0, 8.0, (n,)), 1, None, 0.02, 0.0025, [8.0], lam=1e-6).orderBy("site_id").toPandas()
    assert np.corrcoef(got["ux"], u)[0, 1] > 0.95


def test_displacements_recover_in_two_dimensions(spark):
    rng = np.random.default_rng(5)
    n = 6
    u = rng.uniform(-2e-3, 2e-3, (n, n, 2))
    rows = [(i * n + j, "A", 1, i, j, 1.0, i / n, j / n, float(i / n + u[i, j, 0]), float(j / n + u[i, j, 1])) for i in range(n) for j in range(n)]
    atoms = spark.createDataFrame(rows, "site_id bigint, element string, refnumber int, cell_x int, cell_y int, coeff double, xav double, yav double, x double, y double")
    spec = views.box_spec(atoms, 2, 4.0, 4.0, (n, n))
    got = flows.displacements(atoms, spec, 2, None, 0.04, 0.01, [4.0, 4.0], lam=1e-6).orderBy("site_id").toPandas()
    assert np.corrcoef(got["ux"], u[:, :, 0].ravel())[0, 1] > 0.9 and np.corrcoef(got["uy"], u[:, :, 1].ravel())[0, 1] > 0.9


def test_tiled_field_is_the_same(spark):
    rng = np.random.default_rng(6)
    ampl = spark.createDataFrame([tuple(map(float, rng.normal(size=7))) for _ in range(40)], "qh double, qk double, ql double, a_re double, a_im double, av_re double, av_im double")
    points = spark.createDataFrame([(i, f"n{i % 3}", *map(float, rng.normal(size=3))) for i in range(50)], "site_id bigint, point_no string, px double, py double, pz double")
    args = (["qh", "qk", "ql"], ["px", "py", "pz"], ["site_id", "point_no"])
    a = residual.residual_field(ampl, points, *args).orderBy("site_id").toPandas()
    b = residual.residual_field_tiled(ampl, points, *args, q_rows=7, p_rows=9).orderBy("site_id").toPandas()
    assert list(a["point_no"]) == list(b["point_no"]) and all(np.allclose(a[c], b[c]) for c in ("d_re", "d_im", "av_re", "av_im"))


def test_structure_files(spark, tmp_path):
    (tmp_path / "a.f1d").write_text("Supercell dimensions:\t4\nCell (Ang/deg):\t8.0\nElement\tX\tXav\tRefNumber\tCoeff\nNa\t0.26\t0.25\t1\t2.5\nCl\t0.5\t0.5\t2\t-1\n")
    one = structures.read_structure_1d(spark, str(tmp_path / "a.f1d")).orderBy("site_id").collect()
    assert [(r.element, round(r.x, 6), r.xav, r.refnumber, r.coeff) for r in one] == [("Na", 2.08, 2.0, 1, 2.5), ("Cl", 4.0, 4.0, 2, -1.0)]
    (tmp_path / "b.f2d").write_text("Supercell dimensions: 4 4\nCell (Ang/deg): 8.0 10.0 90.0\nElement X Y Xav Yav RefNumber FF\nNa 0.5 0.5 0.5 0.5 1 3\n")
    two = structures.read_structure_2d(spark, str(tmp_path / "b.f2d")).first()
    assert (round(two.x, 9), round(two.y, 9), two.coeff) == (4.0, 5.0, 3.0)
    (tmp_path / "c.rmc6f").write_text("Supercell dimensions: 2 2 2\nCell (Ang/deg): 8 8 8 90 90 90\nAtoms:\n1 Na [1] 0.1 0.2 0.3 1 0 0 1\n2 Cl 0.5 0.5 0.5 2 1 0 0\n")
    three = structures.read_structure_rmc6f(spark, str(tmp_path / "c.rmc6f")).orderBy("site_id").collect()
    assert [(r.element, r.x, r.refnumber, r.cell_z) for r in three] == [("Na", 0.1, 1, 1), ("Cl", 0.5, 2, 0)]
    (tmp_path / "bad.rmc6f").write_text("Cell (Ang/deg): 8 8 8\nAtoms:\n1 Na 0.1\n")
    with pytest.raises(Exception, match="six numbers|columns"):
        structures.read_structure_rmc6f(spark, str(tmp_path / "bad.rmc6f")).collect()
    (tmp_path / "p.txt").write_text("0.1 0.2 0.3\n")
    assert structures.read_points(spark, str(tmp_path / "p.txt"), 1).count() == 3
    assert structures.read_points(spark, str(tmp_path / "p.txt"), 3).first().p == [0.1, 0.2, 0.3]
    (tmp_path / "r.txt").write_text("h k l\n1 0 0\n0.5 0 0\n")
    assert structures.read_reflections(spark, str(tmp_path / "r.txt")).count() == 2
    (tmp_path / "f.json").write_text('{"Na": {"0": {"a": [1.0], "b": [2.0], "c": 0.5}, "1": {"a": [1.5], "b": [2.0], "c": 0.25}}}')
    assert structures.read_form_factors(spark, str(tmp_path / "f.json")).count() == 2
    (tmp_path / "m.txt").write_text("1 2\n3 4\n")
    assert [(r.i, r.j, r.value) for r in structures.read_coefficients(spark, str(tmp_path / "m.txt")).orderBy("row_no").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_tables_round_trip(spark, tmp_path):
    ampl = spark.createDataFrame([(1, 2.0), (2, 3.0)], "interval_id int, a_re double")
    tables.write_amplitudes(ampl, f"{tmp_path}/a")
    assert tables.read_amplitudes(spark, f"{tmp_path}/a", [2]).first().a_re == 3.0
    tables.write_sites(spark.createDataFrame([(1, "x")], "site_id int, s string"), f"{tmp_path}/s")
    tables.write_sites(spark.createDataFrame([(1, "y"), (2, "z")], "site_id int, s string"), f"{tmp_path}/s")
    assert sorted(r.s for r in spark.read.parquet(f"{tmp_path}/s").collect()) == ["x", "z"]
    field = spark.createDataFrame([(1, 0.5)], "chunk_id int, d_re double")
    tables.write_residual(field, spark.createDataFrame([(1, 9)], "interval_id int, points int"), f"{tmp_path}/r")
    assert [x.count() for x in tables.read_residual(spark, f"{tmp_path}/r")] == [1, 1]
    tables.write_lines(tables.displacement_lines(spark.createDataFrame([(1, 0.25)], "site_id int, ux double")), f"{tmp_path}/t")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t").first().ux == "2.500000E-01"


def test_streamed_partials(spark, tmp_path):
    schema = "interval_id int, p int, d_re double"
    spark.createDataFrame([(1, 7, 1.0), (1, 7, 1.0), (2, 7, 2.0)], schema).write.parquet(f"{tmp_path}/in")
    sums = partials.stream_partials(spark, f"{tmp_path}/in", schema, ["p"], ["interval_id"], ["d_re"])
    partials.run_available(sums, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [tuple(r) for r in partials.latest(spark, f"{tmp_path}/out").collect()] == [(7, 3.0)]
    spark.createDataFrame([(2, 7, 2.0), (3, 7, 4.0)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    partials.run_available(sums, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [tuple(r) for r in partials.latest(spark, f"{tmp_path}/out").collect()] == [(7, 7.0)]
    timed = "interval_id int, p int, d_re double, at timestamp"
    now = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 7, 1.0, now), (1, 7, 1.0, now), (2, 7, 2.0, now)], timed).write.parquet(f"{tmp_path}/in2")
    sums = partials.stream_partials(spark, f"{tmp_path}/in2", timed, ["p"], ["interval_id"], ["d_re"], arrived="at")
    partials.run_available(sums, f"{tmp_path}/out2", f"{tmp_path}/state2").awaitTermination()
    assert [tuple(r) for r in partials.latest(spark, f"{tmp_path}/out2").collect()] == [(7, 3.0)]


def test_old_versions_of_streamed_sums_go(spark, tmp_path):
    schema = "interval_id int, p int, d_re double"
    for n in range(5):
        spark.createDataFrame([(n, 7, 1.0)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        sums = partials.stream_partials(spark, f"{tmp_path}/in", schema, ["p"], ["interval_id"], ["d_re"])
        partials.run_available(sums, f"{tmp_path}/out", f"{tmp_path}/state", keep=2).awaitTermination()
    assert [tuple(r) for r in partials.latest(spark, f"{tmp_path}/out").collect()] == [(7, 5.0)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["version=3", "version=4"]


def test_batches_of_few_rows(spark):
    df = spark.range(5).withColumnRenamed("id", "site_id")
    even = [r.chunk_id for r in sites.batch_even(df, 3, ["site_id"]).orderBy("site_id").collect()]
    assert even == [0, 0, 1, 1, 2]


def test_numbers_of_many_rows_with_more_columns(spark):
    df = spark.range(0, 1_000_000, 1, 7).select(F.xxhash64("id").alias("k"), F.col("id").alias("payload"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    got = ranges.numbered(df, ["k"], ranges=11)
    low, high, rows, different = got.agg(F.min("row_no"), F.max("row_no"), F.count(F.lit(1)), F.count_distinct("row_no")).first()
    assert (low, high, rows, different) == (0, 999_999, 1_000_000, 1_000_000)
    pairs = got.select("k", "row_no").alias("a").join(got.select("k", (F.col("row_no") - 1).alias("row_no")).alias("b"), "row_no")
    assert pairs.where("a.k >= b.k").count() == 0 and pairs.count() == 999_999
    few = sites.batch_even(df.limit(1000).cache(), 3, ["k"]).groupBy("chunk_id").count().collect()
    assert sorted(r["count"] for r in few) == [333, 333, 334]


def test_numbers_of_equal_and_null_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") > 100, F.col("id") % 3).alias("k"), "id")
    got = ranges.numbered(df, ["k", "id"], ranges=16).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(1000)) and [r.k for r in got] == sorted((r.k for r in got), key=lambda x: (x is not None, x))
    assert ranges.numbered(df.where("false"), ["k"]).count() == 0


def test_window_and_taper_values():
    w = features.chebyshev_window(8, 60.0)
    side = np.abs(np.fft.fft(np.append(w, w[0]), 4096))
    edge = int(np.argmax(np.diff(side[:2048]) > 0))  # side lobes lie 60 dB below the peak
    assert abs(20 * np.log10(side[edge:2048].max() / side[0]) + 60) < 0.1 and w.max() == 1
    assert np.allclose(features.band_taper(8, 8, 3.0, 0.5)[:5], [1, 1, 0.75, 0, 0])
    assert np.isclose(features.psf([5, 6], [2.0, None]).sum(), 1.0)


def test_scalars(spark):
    row = spark.createDataFrame([([1.0, 1.0 + 1e-12, 2.0],)], "v array<double>").select(scalars.distinct_tol(F.col("v")).alias("d"), scalars.nearest_index(F.col("v"), F.lit(1.6)).alias("i")).first()
    assert row.d == [1.0, 2.0] and row.i == 2
    assert math.isclose(spark.range(1).select(scalars.lobato(F.lit(0.5), F.array(F.lit(2.0)), F.array(F.lit(3.0)))).first()[0], 2 * 3.5 / 2.5**2)


def test_bounds_of_a_grid(spark):
    """As the points have them, also for ends between grid points and intervals without any."""
    rows = [(1, -0.9, -0.3, 0.0, 0.6, 4.0, 5.0), (2, 0.1, 0.2, 0.0, 1.0, 4.0, 5.0), (3, 0.26, 1.1, 0.1, 0.9, 4.0, 5.0)]
    made = spark.createDataFrame(rows, "interval_id int, h_start double, h_end double, k_start double, k_end double, h_size double, k_size double")
    sizes = [F.col("h_size"), F.col("k_size")]
    q = grids.q_grid(made, sizes)
    want = q.agg(F.min("h"), F.max("h"), F.min("k"), F.max("k")).first()
    assert tuple(grids.axis_bounds(made, sizes, "hk").first()) == tuple(want) == (-0.75, 1.0, 0.0, 0.8)
