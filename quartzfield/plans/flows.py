"""The two complete runs: chemical contrast and displacements, as one lazily composed DataFrame each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import TWO_PI, minimum_image
from ..operators import grids, residual, scattering, separable, weights
from ..operators.arrays import sum_arrays
from ..operators.decoder import apply_decoder_family, decoder_key, patch_spec, train_decoder_family
from ..operators.features import site_features
from ..sources.tables import applied_pairs, applied_partials, stored, write_partials

HKL, XYZ = "hkl", "xyz"


def grid_of(spec: DataFrame, dims: int, mask: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Intervals of a one-row specification, and their points with q = 2 pi S h for fractions of the box."""
    intervals = grids.make_intervals(spec, dims).crossJoin(F.broadcast(spec.select(*(f"{a}_size" for a in HKL[:dims]))))
    q = grids.q_grid(intervals, [F.col(f"{a}_size") for a in HKL[:dims]], mask)
    return intervals, q.withColumns({f"q{a}": F.lit(TWO_PI) * F.col(a) * F.col(f"{a}_size") for a in HKL[:dims]})


#: Pairs of rows up to which the column form of a transform is used: Spark compares every pair, which is quicker than tiles for few.
COLUMN_PAIRS = 100_000_000


def form_of(atoms: DataFrame, q: DataFrame, points: DataFrame) -> str:
    """``columns`` if both transforms have few pairs by count, else ``separable``."""
    many = max(atoms.count(), points.count()) * q.count()
    return "columns" if many <= COLUMN_PAIRS else "separable"


def patches(atoms: DataFrame, sites: DataFrame, spec: DataFrame, dims: int, mask: Column | None, true_axes: Sequence[str], origins: Sequence[str]) -> DataFrame:
    """As ``transform`` by separable sums, but one row for each site: an array of each value over its patch."""
    intervals, q = grid_of(spec, dims, mask)
    index = [f"i{a}" for a in HKL[:dims]]
    ampl = separable.amplitudes_separable(atoms, q, index, true_axes, origins)
    field = separable.residual_patches(ampl, sites, index, XYZ[:dims])
    return _scaled(field, intervals, dims)


def _scaled(field: DataFrame, intervals: DataFrame, dims: int) -> DataFrame:
    """Arrays divided by the point count of all intervals before masking."""
    total = intervals.agg(F.sum(grids.count_reciprocal_points([F.col(f"{a}_size") for a in HKL[:dims]])).alias("_t"))
    scaled = {v: F.when(F.col("_t") > 0, F.transform(v, lambda x: x / F.col("_t"))).otherwise(F.col(v)) for v in separable.FIELD}
    return field.crossJoin(F.broadcast(total)).withColumns(scaled).drop("_t")


def transform(atoms: DataFrame, sites: DataFrame, spec: DataFrame, dims: int, mask: Column | None, true_axes: Sequence[str], origins: Sequence[str], form: str | None = None) -> DataFrame:
    """Atoms to amplitudes to the residual field on the sites' patches, divided by the point count of all intervals.

    ``form``: ``columns`` (every pair is a row), ``tiled`` (matrix products, an exponential for each pair) or ``separable`` (exponentials by axis); None counts and
    takes columns for few pairs, separable sums beyond.
    """
    intervals, q = grid_of(spec, dims, mask)
    keys, q_axes = [f"i{a}" for a in HKL[:dims]], [f"q{a}" for a in HKL[:dims]]
    points, p_axes = grids.patch_grid(sites, XYZ[:dims]), [f"p{a}" for a in XYZ[:dims]]
    form = form or form_of(atoms, q, points)
    if form == "separable":
        return separable.patch_rows(patches(atoms, sites, spec, dims, mask, true_axes, origins), sites, XYZ[:dims])
    if form == "tiled":
        number = F.col(keys[0]).cast("bigint")
        for k in keys[1:]:
            number = number * (1 << 20) + F.col(k)
        q = q.withColumn("q_id", number)
        sums = scattering.amplitudes_tiled(atoms, q, q_axes, true_axes, origins, "q_id")
        ampl = sums.join(q.select("q_id", *q_axes), "q_id")
    elif form == "columns":
        ampl = scattering.amplitudes(atoms, q, q_axes, true_axes, origins, [*keys, *q_axes])
    else:
        raise ValueError(f"unknown form {form}")
    back = residual.residual_field_tiled if form == "tiled" else residual.residual_field
    field = back(ampl, points, q_axes, p_axes, ["site_id", "point_no", *p_axes])
    total = intervals.agg(F.sum(grids.count_reciprocal_points([F.col(f"{a}_size") for a in HKL[:dims]])))
    return residual.normalize_residual(field, total)


def chemical_contrast(atoms: DataFrame, spec: DataFrame, dims: int, mask: Column | None, rules: DataFrame | None = None, form: str | None = None) -> DataFrame:
    """Contrast of each site: coefficients centred, true positions replaced by average ones, values at the patch centres."""
    average = [f"{a}av" for a in XYZ[:dims]]
    centred = weights.center_coefficients(atoms, "global")
    base = atoms if rules is None else atoms.join(rules, ["element", "refnumber"])
    zero = F.array(*[F.lit(0.0)] * dims)
    sites = base.select("site_id", *(F.col(v).alias(a) for a, v in zip(XYZ, average, strict=False)), *((zero.alias("dist"), zero.alias("step")) if rules is None else ("dist", "step")))
    field = transform(centred, sites, spec, dims, mask, average, average, form)
    values = residual.centre_value(field, sites, XYZ[:dims], [f"p{a}" for a in XYZ[:dims]], ["d_re", "d_im"])
    placed = sites.select("site_id", *XYZ[:dims]).join(values, "site_id")
    return residual.attach_site_attributes(placed, atoms).withColumnsRenamed({"d_re": "intensity_re", "d_im": "intensity_im"})


def displacement_samples(atoms: DataFrame, sites: DataFrame, field: DataFrame, dims: int, h_max: Sequence[float]) -> DataFrame:
    """Features of each site's patch (``field``: a row for each site, arrays), with its decoder key and its displacement from the average position."""
    made = site_features(field, sites, XYZ[:dims], h_max)
    unit = [[float(i == j) for j in range(dims)] for i in range(dims)]
    target = minimum_image([F.col(a) for a in XYZ[:dims]], [F.col(f"{a}av") for a in XYZ[:dims]], unit)
    truth = atoms.select("site_id", "refnumber", F.array(*target).alias("target"))
    keys = sites.select("site_id", patch_spec(dims).alias("_spec"))
    return made.join(truth, "site_id").join(keys, "site_id").withColumn("decoder_key", decoder_key(F.col("_spec"))).drop("_spec")


def displacements(atoms: DataFrame, spec: DataFrame, dims: int, mask: Column | None, dist: float, step: float, h_max: Sequence[float], lam: float = 1e-3) -> DataFrame:
    """Train on the unmasked field of the same settings, apply to the masked one: ``site_id, ux, uy, uz``.

    A site's patch is one array from the transform on, so features need no gathering of points; those of the unmasked field are stored, as
    training reads them more than once.
    """
    average = [f"{a}av" for a in XYZ[:dims]]
    sites = atoms.select("site_id", *(F.col(v).alias(a) for a, v in zip(XYZ, average, strict=False)), F.array(*[F.lit(dist)] * dims).alias("dist"), F.array(*[F.lit(step)] * dims).alias("step"))
    true = list(XYZ[:dims])
    teach = stored(displacement_samples(atoms, sites, patches(atoms, sites, spec, dims, None, true, average), dims, h_max))
    matrix = train_decoder_family(teach.select("decoder_key", "features", "target"), lam=lam)
    asked = teach if mask is None else displacement_samples(atoms, sites, patches(atoms, sites, spec, dims, mask, true, average), dims, h_max)
    return apply_decoder_family(asked.select("site_id", "decoder_key", "features"), matrix)


_PARTIALS = "site_id bigint, " + ", ".join(f"{f} array<double>" for f in separable.FIELD) + ", interval_id string, chunk_id int"


def interval_label(dims: int) -> Column:
    """Name of an interval by the grid indices of its ends, which stays the same when a run is extended."""
    ends = [F.round(F.col(f"{a}_{end}") * F.col(f"{a}_size")).cast("int").cast("string") for a in HKL[:dims] for end in ("start", "end")]
    return F.concat_ws("_", *ends)


def advance(atoms: DataFrame, sites: DataFrame, spec: DataFrame, dims: int, mask: Column | None, true_axes: Sequence[str], origins: Sequence[str], path: str, at_once: int = 16, waves: int | None = None) -> int:
    """Add what is missing to a run stored under ``path``; returns the number of pairs of an interval and a chunk that were added.

    ``sites`` have ``chunk_id``. The intervals are those of ``spec``, the pairs those that are not applied yet: all of a new run, the new intervals after
    the specification was extended, the new chunks after sites were, or the rest of a run that broke off. Intervals are taken
    ``at_once`` in a wave, at most ``waves`` of them. A wave computes amplitudes of its intervals alone, stores each pair's partial sums in a folder of its own and
    then commits the pairs, so one that breaks off loses its wave at most, and one that runs twice adds nothing twice. All calls of one ``path`` must
    have the same atoms, mask and patches.
    """
    spark = atoms.sparkSession
    intervals, q = grid_of(spec, dims, None)
    named = intervals.withColumn("interval_id", interval_label(dims))
    chunks = sites.select(F.col("chunk_id").cast("int").alias("chunk_id"))
    pending = stored(residual.pending_pairs(named, chunks, applied_pairs(spark, path)))
    names = [r.interval_id for r in pending.select("interval_id").distinct().orderBy("interval_id").collect()]
    index = [f"i{a}" for a in HKL[:dims]]
    added = 0
    for n, first in enumerate(range(0, len(names), at_once)):
        if waves is not None and n >= waves:
            break
        wave = pending.where(F.col("interval_id").isin(names[first : first + at_once]))
        grid = q.withColumn("interval_id", interval_label(dims)).where(F.col("interval_id").isin(names[first : first + at_once]))
        grid = grid if mask is None else grid.where(mask)
        ampl = separable.amplitudes_separable(atoms, grid, index, true_axes, origins).join(grid.select("interval_id", *index), index)
        parts = separable.residual_partials(ampl, sites.withColumn("chunk_id", F.col("chunk_id").cast("int")), wave, index, XYZ[:dims])
        write_partials(parts, wave, path)
        added += wave.count()
    return added


def collected(spark: SparkSession, spec: DataFrame, dims: int, path: str) -> DataFrame:
    """The field of all applied pairs of a stored run, divided by the point count of all intervals of ``spec``: arrays by site, as ``patches`` gives."""
    field = sum_arrays(applied_partials(spark, path, _PARTIALS), ["site_id"], separable.FIELD)
    intervals = grids.make_intervals(spec, dims).crossJoin(F.broadcast(spec.select(*(f"{a}_size" for a in HKL[:dims]))))
    return _scaled(field, intervals, dims)
