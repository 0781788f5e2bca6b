"""Ranges, numbers, chains and quantiles against plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfield.operators import ranges, weights


def test_numbers_within_groups_cross_ranges(spark):
    df = spark.range(0, 3000, 1, 5).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("k"), "id").withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    got = ranges.numbered(df, ["k"], "n", by=["g"], ranges=13, total="t").toPandas()
    assert list(got.columns) == ["g", "k", "id", "n", "t"] and set(got["t"]) == {1000}
    for _, rows in got.groupby("g", dropna=False):
        assert list(rows.sort_values("n")["k"]) == sorted(rows["k"]) and sorted(rows["n"]) == list(range(1000))


def test_one_value_of_many_rows_is_spread(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit(7).alias("k"), "id")
    made = ranges.ranged(df, ["k"], 10).groupBy(ranges.range_of().alias("r")).count().collect()
    assert len(made) == 10 and max(r["count"] for r in made) < 4000
    got = ranges.numbered(df, ["k"], ranges=10)
    assert got.select("row_no").distinct().count() == 20_000


def test_time_does_not_grow_with_ranges(spark):
    df = spark.range(0, 200_000, 1, 4).select(F.xxhash64("id").alias("k"))
    took = []
    for n in (4, 4, 64):
        began = time.time()
        assert ranges.numbered(df, ["k"], ranges=n).agg(F.max("row_no")).first()[0] == 199_999
        took.append(time.time() - began)
    assert took[2] < 4 * took[1] + 10


def kept(values, tol):
    out = []
    for x in sorted(set(values)):
        if not out or x - out[-1] > tol:
            out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 25])
def test_chains_across_ranges(spark, n):
    """Dense groups without any gap over many ranges, sparse ones, one of a single value, one without a name."""
    r = random.Random(8)
    groups = {"dense": [r.random() for _ in range(400)], "steps": [0.01 * i for i in range(200)], "sparse": [float(i) for i in range(60)], "one": [3.0] * 20, None: [r.random() * 3 for _ in range(80)]}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("one", None), ("one", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    for tol in (0.05, 0.0105, 1e-10):
        got = {}
        for row in ranges.distinct_tol_rows(df, ["g"], "x", tol, ranges=n).collect():
            got.setdefault(row.g, []).append(row.x)
        assert {k: sorted(v) for k, v in got.items()} == {k: kept(v, tol) for k, v in groups.items()}, (n, tol)


def test_chains_of_no_rows(spark):
    assert ranges.distinct_tol_rows(spark.createDataFrame([], "g int, x double"), ["g"], "x").collect() == []


def test_quantiles(spark):
    r = random.Random(6)
    groups = {"one": [4.0], "ties": [1.0] * 50 + [2.0] * 50 + [9.0], "wide": [10.0 ** r.randint(-9, 9) * r.choice((1, -1)) for _ in range(300)], "even": [r.random() for _ in range(2000)], None: [float(i) for i in range(11)], "ends": [-1.7e308, 1.7e308, 0.0, 5.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("nothing", None), ("even", float("nan"))]
    shares = (0.0, 0.01, 0.37, 0.5, 0.995, 1.0)
    got = {x["g"]: [x[f"p{i}"] for i in range(6)] for x in ranges.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, bins=64, few=20).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = np.sort(vs)
        for share, x in zip(shares, got[k], strict=True):
            at = share * (len(s) - 1)
            a, f = int(at), at - int(at)
            assert x == pytest.approx(s[a] if not f else (1 - f) * s[a] + f * s[a + 1], rel=1e-12), (k, share)
    whole = ranges.exact_percentiles(spark.range(1001).select(F.col("id").cast("double").alias("v")), [], "v", (0.25, 0.5), bins=4, few=10).first()
    assert tuple(whole) == (250.0, 500.0)


def test_coefficients_must_be_as_many_as_atoms(spark):
    atoms = spark.createDataFrame([(5,), (3,), (9,)], "site_id int")

    def given(n):
        return spark.createDataFrame([(i, float(i)) for i in range(n)], "row_no bigint, value double")

    assert [r.coeff for r in weights.coefficients_by_position(atoms, given(3)).orderBy("site_id").collect()] == [0.0, 1.0, 2.0]
    assert {r.coeff for r in weights.coefficients_by_position(atoms, given(1)).collect()} == {0.0}
    for n in (2, 5):
        with pytest.raises(Exception, match=f"coefficients: {n}, atoms: 3"):
            weights.coefficients_by_position(atoms, given(n)).collect()
