"""Stored runs: broken off, repeated and extended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfield.operators import separable
from quartzfield.plans import flows, views
from quartzfield.sources import tables


@pytest.fixture(scope="module")
def crystal(spark):
    rng = np.random.default_rng(12)
    n = 5
    rows = [(i * n + j, "A", 1, i, j, float(rng.normal()), i / n, j / n, float(i / n + rng.normal() * 1e-3), float(j / n + rng.normal() * 1e-3)) for i in range(n) for j in range(n)]
    atoms = spark.createDataFrame(rows, "site_id bigint, element string, refnumber int, cell_x int, cell_y int, coeff double, xav double, yav double, x double, y double")
    sites = atoms.select("site_id", F.col("xav").alias("x"), F.col("yav").alias("y"), F.array(F.lit(0.02), F.lit(0.01)).alias("dist"), F.array(F.lit(0.01), F.lit(0.05)).alias("step"), (F.col("site_id") % 4).cast("int").alias("chunk_id"))
    return atoms, sites, lambda limit: views.box_spec(atoms, 2, limit, 0.4, (n, n))


ARGS = (["x", "y"], ["xav", "yav"])


def frame(field):
    out = field.orderBy("site_id").toPandas()
    return list(out["site_id"]), [np.stack(out[c]) for c in separable.FIELD]


def same(a, b):
    return a[0] == b[0] and all(np.allclose(x, y) for x, y in zip(a[1], b[1], strict=True))


def test_resumed_equals_one_run(spark, crystal, tmp_path):
    atoms, sites, spec = crystal
    mask = F.col("h") > -0.5
    want = frame(flows.patches(atoms, sites, spec(0.8), 2, mask, *ARGS))
    path = str(tmp_path)
    some = flows.advance(atoms, sites.where("chunk_id < 2"), spec(0.8), 2, mask, *ARGS, path, at_once=3, waves=2)
    assert some == 6 * 2
    rest = flows.advance(atoms, sites, spec(0.8), 2, mask, *ARGS, path, at_once=5)
    assert some + rest == 16 * 4 and flows.advance(atoms, sites, spec(0.8), 2, mask, *ARGS, path) == 0
    assert same(frame(flows.collected(spark, spec(0.8), 2, path)), want)


def test_a_wave_that_broke_off_is_replaced(spark, crystal, tmp_path, monkeypatch):
    """Partial sums without their commit are there twice as long as the wave is not repeated, but never counted."""
    atoms, sites, spec = crystal
    path = str(tmp_path)
    plain = tables.write_partials

    def broken(parts, pairs, to):
        tables._replace(parts.withColumns({f: F.transform(f, lambda x: x + 7.0) for f in separable.FIELD}), ["interval_id", "chunk_id"], f"{to}/partials")
        raise RuntimeError("the driver was lost")

    monkeypatch.setattr(flows, "write_partials", broken)
    with pytest.raises(RuntimeError):
        flows.advance(atoms, sites, spec(0.4), 2, None, *ARGS, path)
    assert flows.collected(spark, spec(0.4), 2, path).count() == 0
    monkeypatch.setattr(flows, "write_partials", plain)
    flows.advance(atoms, sites, spec(0.4), 2, None, *ARGS, path)
    assert same(frame(flows.collected(spark, spec(0.4), 2, path)), frame(flows.patches(atoms, sites, spec(0.4), 2, None, *ARGS)))


def test_extended_run_adds_new_intervals_only(spark, crystal, tmp_path):
    atoms, sites, spec = crystal
    path = str(tmp_path)
    assert flows.advance(atoms, sites, spec(0.4), 2, None, *ARGS, path) == 4 * 4
    assert flows.advance(atoms, sites, spec(0.8), 2, None, *ARGS, path) == 12 * 4
    assert same(frame(flows.collected(spark, spec(0.8), 2, path)), frame(flows.patches(atoms, sites, spec(0.8), 2, None, *ARGS)))
