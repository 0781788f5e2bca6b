"""The decoding queries, which SQL cannot express, against numpy over all sites of the smallest table."""

import os

import numpy as np
import pytest

from quartzfield.operators import features
from quartzfield.plans import views
from quartzfield.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def atoms(spark):
    return views.atoms_2d(spark, DATA).orderBy("site_id").toPandas()


def field(atoms, axes, grid, keep, offsets):
    """Real part of the normalised residual on every site's patch, by plain sums."""
    r, o, c = atoms[axes].to_numpy(), atoms[[f"{a}av" for a in axes]].to_numpy(), atoms["coeff"].to_numpy()
    q = 2 * np.pi * grid[keep]
    full, origin = np.exp(1j * q @ r.T), np.exp(1j * q @ o.T)
    delta = full @ c - origin.sum(1) * ((full * origin.conj()) @ c) / len(c)
    points = o[:, None, :] + offsets[None]
    return np.stack([(np.exp(-1j * p @ q.T) @ delta).real for p in points]) / len(grid), points, o


def vectors(values, points, centres):
    return np.stack([features.feature(p, v, c, [1.0] * p.shape[1]) for p, v, c in zip(points, values, centres, strict=True)])


def decoded(atoms, axes, grid, mask, offsets):
    """Matrix by reference number from the whole field, applied to the masked one."""
    teach = vectors(*field(atoms, axes, grid, np.ones(len(grid), bool), offsets))
    asked = vectors(*field(atoms, axes, grid, mask, offsets))
    d = atoms[axes].to_numpy() - atoms[[f"{a}av" for a in axes]].to_numpy()
    d = d - np.rint(d)
    out = np.zeros_like(d)
    for ref in sorted(set(atoms["refnumber"])):
        mine = (atoms["refnumber"] == ref).to_numpy()
        f = teach[mine]
        m = d[mine].T @ f @ np.linalg.inv(f.T @ f + 1e-3 * np.eye(f.shape[1]))
        out[mine] = asked[mine] @ m.T
    return out


def line():
    h = np.arange(-40, 41)
    return h[:, None].astype(float), np.abs(np.mod(h / 40, 1.0) - 0.5) <= 0.25


OFFSETS = -0.05 + 0.0125 * np.arange(9)


def test_patch_features(spark, atoms):
    grid, mask = line()
    want = vectors(*field(atoms, ["x"], grid, mask, OFFSETS[:, None]))
    got = QUERIES["k9_patch_features"](spark, DATA).toPandas().pivot(index="site_id", columns="feature", values="value").sort_index()
    assert list(got.index) == list(atoms["site_id"]) and np.allclose(got.to_numpy(), want, atol=1e-8)


def test_displacements_1d(spark, atoms):
    grid, mask = line()
    want = decoded(atoms, ["x"], grid, mask, OFFSETS[:, None])
    got = QUERIES["k14_displacements_1d"](spark, DATA).orderBy("site_id").toPandas()
    assert list(got["site_id"]) == list(atoms["site_id"]) and np.allclose(got["ux"], want[:, 0], atol=1e-7)


def test_displacements_2d(spark, atoms):
    ih, ik = np.meshgrid(np.arange(-8, 9), np.arange(-10, 11), indexing="ij")
    grid = np.stack([ih.ravel(), ik.ravel()], 1).astype(float)
    mask = np.abs(grid[:, 0] / 40) + np.abs(grid[:, 1] / 50) > 0.1
    offsets = np.stack(np.meshgrid(OFFSETS, OFFSETS, indexing="ij"), -1).reshape(-1, 2)
    want = decoded(atoms, ["x", "y"], grid, mask, offsets)
    got = QUERIES["k14_displacements_2d"](spark, DATA).orderBy("site_id").toPandas()
    assert list(got["site_id"]) == list(atoms["site_id"])
    assert np.allclose(got[["ux", "uy"]].to_numpy(), want, atol=1e-7)
