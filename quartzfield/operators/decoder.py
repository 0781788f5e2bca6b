"""Linear decoders from patch features to displacements: ridge regression, one matrix for each key, by Gram sums or conjugate gradients."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import forget, stored
from .arrays import sum_arrays

VERSION = 1


def solve_ridge(rr: np.ndarray, ur: np.ndarray, lam: float) -> np.ndarray:
    """U R^T (R R^T + lam I)^-1 from its two products; a singular matrix is pseudo-inverted."""
    h = rr + lam * np.eye(len(rr))
    try:
        return ur @ np.linalg.inv(h)
    except np.linalg.LinAlgError:
        return ur @ np.linalg.pinv(h, rcond=1e-12)


def solve_dual(r: np.ndarray, u: np.ndarray, lam: float) -> np.ndarray:
    """The same matrix as U (R^T R + lam I)^-1 R^T, for fewer samples (columns) than features."""
    return u @ np.linalg.solve(r.T @ r + lam * np.eye(r.shape[1]), r.T)


def train_decoder_family(samples: DataFrame, key: str = "decoder_key", lam: float = 1e-3, cells: int = 1 << 24) -> DataFrame:
    """``key, row_no, weights``: a decoder for each key from ``features`` and ``target`` arrays.

    Three ways to the same matrix, chosen for each key by what must be held at once, ``cells`` numbers at most (128 MB): with few features each task sums
    Gram products and only those move; with fewer samples than features the dual form is solved from the samples themselves; keys with many of
    both take conjugate gradients (``conjugate_ridge``), which hold no square at all. No samples is an error.
    """
    sizes = stored(samples.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("features")).cast("bigint").alias("_p")))
    n, p = F.col("_n"), F.col("_p")
    form = F.when((n < p) & (n * p <= cells), "dual").when(p * p <= cells, "gram").otherwise("gradients")
    formed = sizes.select(key, form.alias("_form"))
    there = {r["_form"] for r in formed.select("_form").distinct().collect()}
    wide = samples.join(formed, key).select(F.col(key).alias("key"), "features", "target", "_form")
    schema = "key string, row_no int, weights array<double>"

    def rows(name: str, m: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": name, "row_no": range(len(m)), "weights": list(m)})

    def dual(group: pd.DataFrame) -> pd.DataFrame:
        return rows(group["key"].iloc[0], solve_dual(np.stack(group["features"]).T, np.stack(group["target"]).T, lam))

    def sums(batches):
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for name, group in batch.groupby("key"):
                r, u = np.stack(group["features"]).T, np.stack(group["target"]).T
                both = [r @ r.T, u @ r.T]
                held[name] = [a + b for a, b in zip(held[name], both, strict=True)] if name in held else both
        for name, (rr, ur) in held.items():
            yield pd.DataFrame({"key": [name], "rr": [rr.ravel()], "ur": [ur.ravel()], "p": [len(rr)]})

    def primal(group: pd.DataFrame) -> pd.DataFrame:
        p = int(group["p"].iloc[0])
        rr = np.sum(np.stack(group["rr"]), axis=0).reshape(p, p)
        return rows(group["key"].iloc[0], solve_ridge(rr, np.sum(np.stack(group["ur"]), axis=0).reshape(-1, p), lam))

    out = samples.sparkSession.createDataFrame([], schema)
    if "dual" in there:
        out = out.unionByName(wide.where("_form = 'dual'").groupBy("key").applyInPandas(dual, schema))
    if "gram" in there:
        # a key's sums are one row for each task that has samples of it
        parts = wide.where("_form = 'gram'").select("key", "features", "target").mapInPandas(sums, "key string, rr array<double>, ur array<double>, p int")
        out = out.unionByName(parts.groupBy("key").applyInPandas(primal, schema))
    if "gradients" in there:
        out = out.unionByName(conjugate_ridge(wide.where("_form = 'gradients'").drop("_form"), lam))
    return out.withColumnRenamed("key", key)


def _sample_tiles(samples: DataFrame, cells: int) -> DataFrame:
    """(key, p, f, u): features and targets of some samples of a key in a row, about ``cells`` numbers; written once, read by every step."""
    sized = samples.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("features")).alias("p"))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("p") / cells))
    dealt = samples.join(sized, "key").withColumn("_tile", F.pmod(F.xxhash64("features"), tiles))
    rows = F.struct("features", "target")
    tile = dealt.groupBy("key", "p", "_tile").agg(F.collect_list(rows).alias("s"))
    return stored(tile.select("key", "p", F.flatten("s.features").alias("f"), F.flatten("s.target").alias("u")))


def conjugate_ridge(samples: DataFrame, lam: float = 1e-3, tolerance: float = 1e-11, max_steps: int = 2000, cells: int = 1 << 20) -> DataFrame:
    """``key, row_no, weights`` of ridge regression by conjugate gradients with a diagonal preconditioner, from ``key, features, target``.

    A step multiplies every sample's features with the search directions of its key and adds the products up: matrix times vector as a
    distributed sum, so a task holds a tile of samples (8 MB) and a few vectors of the features' length. Keys step together until each residual is
    ``tolerance`` of the right-hand side; ``max_steps`` without that is an error. The state of a step is a stored table, one row for each key.
    """
    tiles = _sample_tiles(samples, cells)
    vectors = "key string, p int, b array<double>, c array<double>"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def product(f: np.ndarray, u: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
            return u.T @ f, (f * f).sum(0)

        return _products(batches, product, None)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def product(f: np.ndarray, _, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (d @ f.T) @ f, np.zeros(0)

        return _products(batches, product, "d")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p = batch.column("p")[row].as_py()
                b, diagonal = _numbers(batch, "b", row).reshape(-1, p), _numbers(batch, "c", row) + lam
                z = b / diagonal
                yield _state(batch.column("key")[row].as_py(), p, np.zeros_like(b), b, z, (b * z).sum(1), (b * b).sum(1), diagonal)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p = batch.column("p")[row].as_py()
                x, r, d, q = (_numbers(batch, c, row).reshape(-1, p) for c in ("x", "r", "d", "b"))
                rz, whole, diagonal = (_numbers(batch, c, row) for c in ("rz", "whole", "diagonal"))
                q = q + lam * d
                alpha = np.divide(rz, (d * q).sum(1), out=np.zeros_like(rz), where=rz > 0)[:, None]
                x, r = x + alpha * d, r - alpha * q
                z = r / diagonal
                new = (r * z).sum(1)
                new[(r * r).sum(1) <= tolerance**2 * whole] = 0.0  # this target's direction is at rest
                d = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0)[:, None] * d
                d[new == 0] = 0.0
                yield _state(batch.column("key")[row].as_py(), p, x, r, d, new, whole, diagonal)

    state = stored(sum_arrays(tiles.mapInArrow(start, vectors), ["key", "p"], ["b", "c"]).mapInArrow(begin, _STATE))
    for _ in range(max_steps):
        moving = state.where(F.exists("rz", lambda z: z > 0))
        if moving.isEmpty():
            break
        # the directions of a key join its tiles once for each, not for each sample; Spark broadcasts them while they are small
        parts = tiles.join(moving.select("key", "d"), "key").mapInArrow(step, vectors)
        turned = sum_arrays(parts, ["key", "p"], ["b"])
        rest = state.join(moving.select("key"), "key", "left_anti")
        after = stored(moving.join(turned.select("key", "b"), "key").mapInArrow(advance, _STATE).unionByName(rest))
        forget(state)
        state = after
    else:
        raise ArithmeticError(f"no convergence in {max_steps} steps")
    forget(tiles)
    rows = F.transform(F.sequence(F.lit(0), (F.size("x") / F.col("p")).cast("int") - 1), lambda i: F.slice("x", i * F.col("p") + 1, F.col("p")))
    return state.select("key", F.posexplode(rows).alias("row_no", "weights"))


_STATE = "key string, p int, x array<double>, r array<double>, d array<double>, rz array<double>, whole array<double>, diagonal array<double>"


def _state(key: str, p: int, *vectors: np.ndarray) -> pa.RecordBatch:
    made = [pa.array([v.ravel()], pa.list_(pa.float64())) for v in vectors]
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([p], pa.int32()), *made], names=["key", "p", "x", "r", "d", "rz", "whole", "diagonal"])


def _numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _products(batches: Iterator[pa.RecordBatch], product: Callable, direction: str | None) -> Iterator[pa.RecordBatch]:
    """Products of tiles, summed over the tiles of one key that follow each other."""
    key, p, sums = None, 0, None
    for batch in batches:
        for row in range(batch.num_rows):
            now = batch.column("key")[row].as_py()
            if now != key and sums is not None:
                yield _vectors(key, p, sums)
                sums = None
            key, p = now, batch.column("p")[row].as_py()
            f = _numbers(batch, "f", row).reshape(-1, p)
            u = _numbers(batch, "u", row).reshape(len(f), -1)
            made = product(f, u, None if direction is None else _numbers(batch, direction, row).reshape(-1, p))
            sums = made if sums is None else tuple(a + b for a, b in zip(sums, made, strict=True))
    if sums is not None:
        yield _vectors(key, p, sums)


def _vectors(key: str, p: int, sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    made = [pa.array([s.ravel()], pa.list_(pa.float64())) for s in sums]
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([p], pa.int32()), *made], names=["key", "p", "b", "c"])


def train_decoder(samples: DataFrame, lam: float = 1e-3) -> DataFrame:
    """One decoder for all samples."""
    if samples.isEmpty():
        raise ValueError("no training samples")
    return train_decoder_family(samples.withColumn("decoder_key", F.lit("all")), lam=lam)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def apply_decoder_family(features: DataFrame, decoder: DataFrame, key: str = "decoder_key", names: Sequence[str] = ("ux", "uy", "uz")) -> DataFrame:
    """``site_id`` and u = M f by the matrix of the row's key. A missing key or another length of features is an error."""
    matrix = decoder.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row_no", "weights"))).alias("_m"))
    joined = features.join(matrix, key, "left")
    fits = F.col("_m").isNotNull() & (F.size(F.col("_m")[0]["weights"]) == F.size("features"))
    checked = F.when(fits, F.col("_m")).otherwise(F.raise_error(F.concat(F.lit("no decoder of this size for "), F.col(key))).cast("array<struct<row_no:int,weights:array<double>>>"))
    u = F.transform(checked, lambda row: _dot(row["weights"], F.col("features")))
    return joined.withColumn("_u", u).select("site_id", *(F.get("_u", F.lit(i)).alias(n) for i, n in enumerate(names)))


def apply_decoder(features: DataFrame, decoder: DataFrame, names: Sequence[str] = ("ux", "uy", "uz")) -> DataFrame:
    return apply_decoder_family(features.withColumn("decoder_key", F.lit("all")), decoder, "decoder_key", names)


def patch_spec(dims: int, dist: str = "dist", step: str = "step", kind: str = "cheb", at: float = 100.0, guard: float = 0.10, gamma: float = 0.35) -> Column:
    """Text of what must agree between two patches for one decoder to serve both."""
    numbers = [F.format_string("%.12f", F.round(F.col(c)[i], 12)) for c in (dist, step) for i in range(dims)]
    return F.concat_ws("|", F.lit(str(dims)), *numbers, F.lit(kind), F.lit(f"{at:g}"), F.lit(f"{guard:g}"), F.lit(f"{gamma:g}"), F.lit(str(VERSION)))


def decoder_key(spec: Column, refnumber: str = "refnumber", site: str = "site_id") -> Column:
    """Site class and patch: the reference number if there is one, else the site itself."""
    group = F.when(F.col(refnumber).isNotNull(), F.concat(F.lit("reference_number:"), F.col(refnumber).cast("string"))).otherwise(F.concat(F.lit("central_point_id:"), F.col(site).cast("string")))
    return F.concat_ws("#", group, spec)


def check_patch_specs(sites: DataFrame, spec: Column, single: bool) -> DataFrame:
    """Reference numbers with more than one patch; in single mode more than one patch at all, or such a conflict, is an error on reading."""
    by = sites.withColumn("_spec", spec).groupBy("refnumber").agg(F.countDistinct("_spec").alias("specs"), F.min("_spec").alias("_low"), F.max("_spec").alias("_high"))
    if not single:
        return by.select("refnumber", "specs")
    span = by.agg(F.min("_low").alias("_a"), F.max("_high").alias("_b"))
    wrong = F.when(F.col("_a") != F.col("_b"), F.raise_error(F.lit("sites have different patches; use one decoder for each")).cast("bigint"))
    return by.crossJoin(F.broadcast(span)).select("refnumber", F.coalesce(wrong, F.col("specs")).alias("specs"))


def decoder_source(mode: str, path: str | None, settings: dict, compute: Callable[[], DataFrame], spark=None, family: bool = False) -> DataFrame:
    """A decoder table: ``compute`` runs the unmasked samples and keeps the matrix under ``path`` if there is one, ``cache`` reads one of the same settings, ``error`` refuses."""
    if mode == "compute":
        made = compute()
        if path and not family:
            write_decoder(made, path, settings)
        return made
    if mode == "cache":
        if family:
            raise ValueError("decoders by key are not cached")
        return spark.read.parquet(f"{path}/decoder_{settings_key(settings)}")
    if mode == "error":
        raise ValueError("there is no decoder; ask for cache or compute")
    raise ValueError(f"unknown decoder source {mode}")


def write_decoder(matrix: DataFrame, path: str, settings: dict) -> None:
    """Keep a matrix for runs of the same settings."""
    matrix.write.mode("overwrite").parquet(f"{path}/decoder_{settings_key(settings)}")


def settings_key(settings: dict) -> str:
    return hashlib.sha1(repr(sorted(settings.items())).encode()).hexdigest()


def broadcast_displacement(residual: DataFrame, displacements: DataFrame) -> DataFrame:
    """A site's vector on all its patch points."""
    return residual.join(displacements, "site_id")
