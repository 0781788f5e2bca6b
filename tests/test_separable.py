"""Transforms by axis against numpy: kernels, and tiles, blocks and partial sums on Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfield.operators import features, grids, residual, scattering, separable
from quartzfield.plans import flows, views

RNG = np.random.default_rng(11)


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("dense", [True, False])
def test_kernels(dims, dense):
    """Both ways, over whole boxes and over few points."""
    at = [RNG.random(50) for _ in range(dims)]
    c, units = RNG.random(50), [2 * np.pi, 4.0, 1.5][:dims]
    if dense:
        grid = np.stack(np.meshgrid(*[np.arange(-3, 5)] * dims, indexing="ij")).reshape(dims, -1)
    else:
        grid = RNG.integers(-60, 60, (dims, 9))
    q = grid * np.array(units)[:, None]
    places, per, near = separable._digits(list(grid), units, at)
    numbers, where = separable._axes_of(places)
    got = separable._contract(separable._tables(numbers, per, near, 1.0), c, where)
    assert np.allclose(got, (np.exp(1j * (q.T @ np.array(at))) * c).sum(1))
    centre = [RNG.random(7) for _ in range(dims)]
    offsets = [separable.axis_offsets(0.03, 0.01 * (1 + k)) for k in range(dims)]
    values = RNG.random((2, grid.shape[1])) + 1j * RNG.random((2, grid.shape[1]))
    numbers, where = separable._axes_of(list(grid))
    got = separable._back(numbers, where, values, units, centre, offsets)
    mesh = np.stack(np.meshgrid(*offsets, indexing="ij")).reshape(dims, -1)
    points = np.stack(centre, 1)[:, :, None] + mesh[None]
    assert np.allclose(got, np.einsum("vq,sqp->svp", values, np.exp(-1j * np.einsum("dq,sdp->sqp", q, points))))


def test_offsets_are_those_of_the_patch_grid(spark):
    for dist, step in ((0.01, 0.05), (0.03, 0.01), (0.1, 0.04), (0.2, 0.0), (0.0, 0.0), (0.05, 0.0125)):
        site = spark.createDataFrame([(1, 0.5, [dist], [step])], "site_id bigint, x double, dist array<double>, step array<double>")
        want = [r.px for r in grids.patch_grid(site, ["x"]).orderBy("point_no").collect()]
        assert np.allclose(0.5 + separable.axis_offsets(dist, step), want, atol=0, rtol=1e-15)


@pytest.fixture(params=["broadcast", "cartesian"])
def joined(spark, request):
    """Tiles meet blocks by a broadcast, or as a product of partitions whose partial sums must be added up."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "cartesian":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tiles_and_blocks(spark, joined, monkeypatch):
    monkeypatch.setattr(separable, "EDGES", {2: (4, 3)})
    r, c = RNG.random((60, 2)), RNG.normal(size=60)
    o = np.round(r * 4) / 4
    rows = [("ab"[i % 2], *map(float, a), *map(float, b), float(x)) for i, (a, b, x) in enumerate(zip(r, o, c, strict=True))]
    atoms = spark.createDataFrame(rows, "element string, x double, y double, ox double, oy double, coeff double").repartition(5)
    places = [(i, k) for i in range(-5, 6) for k in range(0, 7) if (i + k) % 3 or i > 3]
    q = spark.createDataFrame(places + places[:5], "ih int, ik int")  # some points twice
    args = (["ih", "ik"], ["x", "y"], ["ox", "oy"], [2.0, 3.0])
    got = {(x.ih, x.ik): x for x in separable.amplitudes_separable(atoms, q, *args, atom_rows=11).collect()}
    k = np.array(places) * [2.0, 3.0]
    full, origin = np.exp(1j * k @ r.T), np.exp(1j * k @ o.T)
    a, av = full @ c, origin.sum(1) * ((full * origin.conj()) @ c) / 60
    assert set(got) == set(places)
    for n, place in enumerate(places):
        assert np.allclose([got[place].a_re, got[place].a_im, got[place].av_re, got[place].av_im], [a[n].real, a[n].imag, av[n].real, av[n].imag])
    by = separable.separable_sums(atoms, q, *args, coeff="coeff", by=("element",), atom_rows=7).groupBy("element").agg(F.count("*").alias("n"), F.max("_n").alias("atoms")).collect()
    assert {(x.element, x.n, x.atoms) for x in by} == {("a", len(places), 30), ("b", len(places), 30)}


def test_patches(spark, joined, monkeypatch):
    monkeypatch.setattr(separable, "EDGES", {2: (4, 3)})
    places = [(i, k) for i in range(-4, 5) for k in range(0, 6)]
    ampl = spark.createDataFrame([(*p, *map(float, RNG.normal(size=4))) for p in places], "ih int, ik int, a_re double, a_im double, av_re double, av_im double").repartition(4)
    kinds = [([0.03, 0.02], [0.01, 0.01]), ([0.01, 0.02], [0.05, 0.01]), ([0.0, 0.0], [0.0, 0.0])]
    sites = spark.createDataFrame([(i, *map(float, RNG.random(2)), *kinds[i % 3]) for i in range(40)], "site_id bigint, x double, y double, dist array<double>, step array<double>").repartition(3)
    field = separable.residual_patches(ampl, sites, ["ih", "ik"], ["x", "y"], cells=60)
    assert field.count() == 40
    got = separable.patch_rows(field, sites, ["x", "y"]).orderBy("site_id", "point_no").toPandas()
    q = ampl.select("*", (F.col("ih") * 6.283185307179586).alias("qh"), (F.col("ik") * 6.283185307179586).alias("qk"))
    points = grids.patch_grid(sites, ["x", "y"])
    want = residual.residual_field(q, points, ["qh", "qk"], ["px", "py"], ["site_id", "point_no", "px", "py"]).orderBy("site_id", "point_no").toPandas()
    assert list(got["site_id"]) == list(want["site_id"]) and list(got["point_no"]) == list(want["point_no"])
    assert all(np.allclose(got[c], want[c]) for c in ("px", "py", *separable.FIELD))


def test_forms_agree_and_are_chosen_by_count(spark, monkeypatch):
    n = 6
    u = RNG.uniform(-2e-3, 2e-3, (n, n, 2))
    rows = [(i * n + j, "A", 1, i, j, 1.0 + i, i / n, j / n, float(i / n + u[i, j, 0]), float(j / n + u[i, j, 1])) for i in range(n) for j in range(n)]
    atoms = spark.createDataFrame(rows, "site_id bigint, element string, refnumber int, cell_x int, cell_y int, coeff double, xav double, yav double, x double, y double")
    sites = atoms.select("site_id", F.col("xav").alias("x"), F.col("yav").alias("y"), F.array(F.lit(0.02), F.lit(0.02)).alias("dist"), F.array(F.lit(0.01), F.lit(0.01)).alias("step"))
    spec = views.box_spec(atoms, 2, 1.0, 1.0, (n, n))
    made = [flows.transform(atoms, sites, spec, 2, None, ["x", "y"], ["xav", "yav"], form).orderBy("site_id", "point_no").toPandas() for form in ("columns", "tiled", "separable")]
    for other in made[1:]:
        assert list(other["point_no"]) == list(made[0]["point_no"])
        assert all(np.allclose(other[c], made[0][c]) for c in ("px", "py", *separable.FIELD))
    points = grids.patch_grid(sites, ["x", "y"])
    q = flows.grid_of(spec, 2)[1]
    assert flows.form_of(atoms, q, points) == "columns"
    monkeypatch.setattr(flows, "COLUMN_PAIRS", 1000)
    assert flows.form_of(atoms, q, points) == "separable"
    with pytest.raises(ValueError):
        flows.transform(atoms, sites, spec, 2, None, ["x", "y"], ["xav", "yav"], "other")
    one = features.patch_features(made_rows(spark, made[0]), sites, ["x", "y"], ["px", "py"], [1.0, 1.0]).orderBy("site_id").toPandas()
    two = features.site_features(flows.patches(atoms, sites, spec, 2, None, ["x", "y"], ["xav", "yav"]), sites, ["x", "y"], [1.0, 1.0]).orderBy("site_id").toPandas()
    assert np.allclose(np.stack(one["features"]), np.stack(two["features"]))


def made_rows(spark, frame):
    return spark.createDataFrame(frame)


def test_columns_stay_right(spark):
    atoms = spark.createDataFrame([(0.25, 0.25, 2.0)], "x double, ox double, coeff double")
    q = spark.createDataFrame([(1, 6.283185307179586)], "ih int, qh double")
    one = scattering.amplitudes(atoms, q, ["qh"], ["x"], ["ox"], ["ih"]).first()
    two = separable.amplitudes_separable(atoms, q, ["ih"], ["x"], ["ox"]).first()
    assert np.allclose(tuple(one), tuple(two))


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("cells", [1 << 21, 50])
def test_atoms_that_share_places_are_summed_axis_by_axis(monkeypatch, dims, cells):
    """No phase for each pair of an atom and a point: the direct sums are not called."""
    monkeypatch.setattr(separable, "CELLS", cells)
    monkeypatch.setattr(separable, "_contract", None)
    grid = np.stack(np.meshgrid(*[np.arange(-2, 3 + i) for i in range(dims)], indexing="ij")).reshape(dims, -1)
    lattice = [RNG.integers(0, n, 2000) / n for n in (4, 5, 6)[:dims]]
    at = [x + RNG.integers(0, 3, 2000) * 1e-3 for x in lattice]
    c, m, units = RNG.normal(size=2000), RNG.integers(1, 4, 2000).astype(float), [2 * np.pi, 4.0, 1.5][:dims]
    got = separable._tile_sums(list(grid), units, at, lattice, c, m, 100)
    full, origin = (np.exp(1j * (grid * np.array(units)[:, None]).T @ np.array(x)) for x in (at, lattice))
    for a, b in zip(got, (full @ c, origin @ m, (full * origin.conj()) @ c), strict=True):
        assert np.allclose(a, b)


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("share", [2, 10**9])
def test_whole_grids(spark, monkeypatch, dims, share):
    """All points in each task, atoms dealt by their places or by chance; groups, equal atoms and many tiles."""
    monkeypatch.setattr(separable, "SHARED", share)
    monkeypatch.setattr(separable, "FEW_TILES", 0)
    monkeypatch.setattr(separable, "dealt", None)  # the tiles of arrays are for other cases
    o = RNG.integers(0, 4, (600, dims)) / 4
    r = o + RNG.integers(0, 2, (600, dims)) * 1e-2
    r, o, c = np.concatenate((r, r[:50])), np.concatenate((o, o[:50])), RNG.normal(size=650)
    kind = RNG.integers(0, 2, 650)
    index, axes, origins = (["ih", "ik", "il"][:dims], list("xyz")[:dims], ["ox", "oy", "oz"][:dims])
    rows = [("ab"[k], *map(float, a), *map(float, b), float(x)) for k, a, b, x in zip(kind, r, o, c, strict=True)]
    atoms = spark.createDataFrame(rows, "element string, " + ", ".join(f"{n} double" for n in (*axes, *origins, "coeff"))).repartition(5)
    places = np.stack(np.meshgrid(*[np.arange(-2, 4)] * dims, indexing="ij")).reshape(dims, -1).T[:-1]
    q = spark.createDataFrame([tuple(map(int, p)) for p in [*places, *places[:3]]], ", ".join(f"{i} int" for i in index))
    full, origin = (np.exp(2j * np.pi * places @ x.T) for x in (r, o))
    for by in ((), ("element",)):
        found = separable.separable_sums(atoms, q, index, axes, origins, by=by, atom_rows=5).collect()
        got = {(*(x[i] for i in index), *(x[b] for b in by)): x for x in found}
        groups = {(): np.ones(650, bool)} if not by else {("a",): kind == 0, ("b",): kind == 1}
        assert len(got) == len(places) * len(groups)
        for g, some in groups.items():
            want = full[:, some] @ c[some], origin[:, some].sum(1), (full * origin.conj())[:, some] @ c[some]
            for n, p in enumerate(places):
                x = got[(*map(int, p), *g)]
                assert x._n == some.sum()
                assert np.allclose([x._a_re, x._a_im, x._o_re, x._o_im, x._d_re, x._d_im], [f(w[n]) for w in want for f in (np.real, np.imag)])


def test_a_missing_weight_is_not_left_out(spark, monkeypatch):
    monkeypatch.setattr(separable, "FEW_TILES", 0)
    atoms = spark.createDataFrame([(0.25, 0.25, 2.0), (0.25, 0.25, None)], "x double, ox double, coeff double")
    q = spark.createDataFrame([(1,)], "ih int")
    x = separable.amplitudes_separable(atoms, q, ["ih"], ["x"], ["ox"], atom_rows=1).first()
    assert np.isnan(x.a_re) and np.isnan(x.av_re)
    none = separable.amplitudes_separable(atoms.limit(0), q, ["ih"], ["x"], ["ox"]).collect()
    assert none == [] and separable.amplitudes_separable(atoms, q.limit(0), ["ih"], ["x"], ["ox"], atom_rows=1).collect() == []


def test_sums_by_element_gather_no_atoms(spark, monkeypatch):
    """Atoms reach the tasks as plain rows: no list of a tile's atoms is built, and none meets points in a join."""
    monkeypatch.setattr(separable, "FEW_TILES", 0)
    atoms = spark.createDataFrame([("ab"[i % 2], i / 7, (i % 3) / 3, 1.0) for i in range(40)], "element string, x double, ox double, coeff double")
    points = spark.createDataFrame([(i, float(i)) for i in range(6)], "ih int, qh double")
    weights = spark.createDataFrame([("a", 2.0), ("b", 0.5)], "element string, f double")
    out = separable.amplitudes_by_element_separable(atoms, points, ["ih"], ["x"], ["ox"], weights, F.col("f"), atom_rows=4)
    sums = separable.separable_sums(atoms, points, ["ih"], ["x"], ["ox"], by=("element",), atom_rows=4)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    r, o, f = (np.array(x) for x in zip(*[(i / 7, (i % 3) / 3, (2.0, 0.5)[i % 2]) for i in range(40)], strict=True))
    want = {n: (np.exp(2j * np.pi * n * r) * f).sum() for n in range(6)}
    assert {x.ih for x in out.collect()} == set(want)
    assert all(np.allclose([x.a_re, x.a_im], [want[x.ih].real, want[x.ih].imag]) for x in out.collect())
