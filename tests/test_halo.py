"""Stencils in blocks against plain loops."""

import random

import numpy as np
import pytest

from quartzfield.operators import analysis, halo


def lattice(spark, size, seed, holes=0.2, twice=0.1):
    r = random.Random(seed)
    rows = []
    for cell in np.ndindex(*size):
        if r.random() > holes:
            rows.append((*map(int, cell), len(rows), f"k{r.randint(0, 2)}", r.random()))
        if rows and r.random() < twice:
            rows.append((*map(int, cell), len(rows), None, r.random()))
    names = [f"g{i}" for i in range(len(size))]
    schema = ", ".join([*(f"{n} int" for n in names), "id int, kind string, v double"])
    return names, rows, spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("size,edge,offsets", [((7, 9), 3, analysis.FOUR), ((7, 9), 100, analysis.FOUR), ((5, 6, 4), 2, analysis.SIX), ((2, 2), 1, [(1, 1), (0, 2), (3, 0)]), ((20,), 4, [(1,), (-3,), (4,)]), ((1, 8), 2, [(1, 0), (0, 1)])])
def test_neighbours(spark, size, edge, offsets):
    names, rows, df = lattice(spark, size, len(size) + edge)
    by = {}
    for row in rows:
        by.setdefault(row[: len(size)], []).append(row)
    want = sorted(repr((*row, other[-3], other[-2])) for row in rows for o in offsets for other in by.get(tuple((g + d) % n for g, d, n in zip(row, o, size, strict=False)), []))
    got = halo.periodic_neighbours(df, names, size, offsets, ["id", "kind"], edge=edge)
    assert got.columns == [*df.columns, "n_id", "n_kind"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


@pytest.mark.parametrize("size,edge", [((11, 13), 9), ((40, 30), 10), ((3, 5), 2)])
def test_smoothing(spark, size, edge):
    """Also of lattices narrower than the reach, with empty cells."""
    names, rows, df = lattice(spark, size, 3, twice=0.0)
    dense, there = np.zeros(size), np.zeros(size)
    for row in rows:
        dense[row[:2]], there[row[:2]] = row[-1], 1
    weights = analysis.gaussian(1.0)
    for axis in range(2):
        dense = sum(np.roll(dense, o, axis) * w for o, w in weights)
        there = sum(np.roll(there, o, axis) for o, _ in weights)
    got = {tuple(r)[:2]: r.v for r in halo.smoothed(df, names, size, "v", weights, edge=edge).collect()}
    assert set(got) == set(zip(*map(list, np.nonzero(there)), strict=True))
    assert all(abs(dense[c] - v) < 1e-12 for c, v in got.items())


def test_one_shuffle(spark):
    names, _, df = lattice(spark, (6, 6), 1)
    plan = halo.periodic_neighbours(df.select(*names, "v"), names, (6, 6), analysis.FOUR, ["v"], edge=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_block") == 1 and "Join" not in plan


def test_empty_lattice(spark):
    df = spark.createDataFrame([], "a int, b int, v double")
    assert halo.periodic_neighbours(df, ["a", "b"], (4, 4), analysis.FOUR, ["v"]).collect() == [] == halo.smoothed(df, ["a", "b"], (4, 4), "v", [(0, 1.0)]).collect()
