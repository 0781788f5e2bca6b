"""Decoders by conjugate gradients against closed forms."""

import numpy as np
import pytest

from quartzfield.operators import decoder
from quartzfield.operators.arrays import sum_arrays


def table(spark, groups):
    rows = [(k, f.tolist(), u.tolist()) for k, (r, t) in groups.items() for f, u in zip(r, t, strict=True)]
    return spark.createDataFrame(rows, "key string, features array<double>, target array<double>").repartition(5)


def weights(frame, key="key"):
    out = {}
    for r in frame.orderBy(key, "row_no").collect():
        out.setdefault(r[key], []).append(r["weights"])
    return {k: np.array(v) for k, v in out.items()}


def test_equal_to_the_closed_form(spark):
    """300 features, keys of their own size and number of targets, one without anything to explain; tiles of a few samples."""
    rng = np.random.default_rng(2)
    groups = {"a": (rng.normal(size=(500, 300)), rng.normal(size=(500, 2))), "b": (rng.normal(size=(40, 300)), rng.normal(size=(40, 3))), "c": (rng.normal(size=(20, 5)), np.zeros((20, 1)))}
    got = weights(decoder.conjugate_ridge(table(spark, groups), lam=300.0, cells=10_000))
    for k, (f, u) in groups.items():
        want = u.T @ f @ np.linalg.inv(f.T @ f + 300.0 * np.eye(f.shape[1]))
        assert got[k].shape == want.shape and np.allclose(got[k], want, atol=1e-8), k


def test_wide_patches_hold_no_square(spark):
    """16 641 features: the square would be 2.2 GB; tiles of 8 MB and vectors of the features' length are all that a task holds."""
    rng = np.random.default_rng(3)
    f, u = rng.normal(size=(24, 16_641)), rng.normal(size=(24, 2))
    got = weights(decoder.conjugate_ridge(table(spark, {"k": (f, u)}), lam=10.0))["k"]
    assert np.allclose(got, decoder.solve_dual(f.T, u.T, 10.0), atol=1e-9)


def test_family_takes_each_way(spark):
    rng = np.random.default_rng(4)
    groups = {"few features": (rng.normal(size=(60, 4)), rng.normal(size=(60, 2))), "few samples": (rng.normal(size=(3, 20)), rng.normal(size=(3, 2))), "many of both": (rng.normal(size=(30, 25)), rng.normal(size=(30, 2)))}
    samples = table(spark, groups).withColumnRenamed("key", "decoder_key")
    got = weights(decoder.train_decoder_family(samples, lam=0.5, cells=100), "decoder_key")
    for k, (f, u) in groups.items():
        assert np.allclose(got[k], u.T @ f @ np.linalg.inv(f.T @ f + 0.5 * np.eye(f.shape[1])), atol=1e-8), k


def test_too_few_steps_is_an_error(spark):
    rng = np.random.default_rng(5)
    samples = table(spark, {"a": (rng.normal(size=(50, 30)), rng.normal(size=(50, 1)))})
    with pytest.raises(ArithmeticError):
        decoder.conjugate_ridge(samples, lam=1e-6, max_steps=2)


def test_sums_of_arrays(spark):
    rows = [("x", 1, [1.0, 2.0], [1.0]), ("x", 1, [3.0, 4.0], [2.0]), ("y", 1, [5.0], []), ("x", 2, [1.0, 1.0], [4.0])]
    got = {(r.k, r.n): (r.a, r.b) for r in sum_arrays(spark.createDataFrame(rows, "k string, n int, a array<double>, b array<double>"), ["k", "n"], ["a", "b"]).collect()}
    assert got == {("x", 1): ([4.0, 6.0], [3.0]), ("y", 1): ([5.0], []), ("x", 2): ([1.0, 1.0], [4.0])}
