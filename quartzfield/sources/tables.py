"""Stored tables and result files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; a session on one machine may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quartzfield-')}"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what several steps read is computed once and outlives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def forget(*made: DataFrame) -> None:
    """Delete what ``stored`` wrote for tables that nothing reads any more."""
    for df in made:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(conf).delete(path, True)


def write_files(df: DataFrame, key: str, order: str, header: list[str], line, path: str) -> None:
    """A text file for each value of ``key``: header lines, then one line a row in the given order. A file must fit a task, as those who read it need it whole."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_rows"))
    text = F.concat_ws("\n", *map(F.lit, header), F.concat_ws("\n", "_rows.l"))
    rows.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _replace(df: DataFrame, by: list[str], path: str) -> None:
    """Write partitions by columns; those that ``df`` has rows of take the place of what was there, so writing twice changes nothing."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _stored_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_amplitudes(df: DataFrame, path: str) -> None:
    """One folder for each interval, so a reader takes only those it asks for; an interval written again replaces its rows."""
    _replace(df, ["interval_id"], path)


def read_amplitudes(spark: SparkSession, path: str, intervals: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if intervals is None else df.where(F.col("interval_id").isin(intervals))


def write_residual(df: DataFrame, applied: DataFrame, path: str) -> None:
    """Residual field by chunk, and next to it which intervals it holds and their point counts."""
    df.repartition("chunk_id").write.mode("append").partitionBy("chunk_id").parquet(f"{path}/residual")
    applied.write.mode("append").parquet(f"{path}/applied")


def read_residual(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/residual"), spark.read.parquet(f"{path}/applied")


_APPLIED = "interval_id string, chunk_id int"


def write_partials(parts: DataFrame, pairs: DataFrame, path: str) -> None:
    """Partial sums of (interval, chunk) pairs, then the pairs themselves, which commits them.

    A pair whose sums were written before the run broke off is not among the applied ones; when it comes again, its folder is replaced.
    """
    _replace(parts, ["interval_id", "chunk_id"], f"{path}/partials")
    pairs.select("interval_id", "chunk_id").write.mode("append").parquet(f"{path}/applied")


def applied_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(interval, chunk) pairs whose partial sums are stored."""
    return _stored_or(spark, f"{path}/applied", _APPLIED).distinct()


def applied_partials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored partial sums of the applied pairs alone."""
    return _stored_or(spark, f"{path}/partials", schema).join(applied_pairs(spark, path), ["interval_id", "chunk_id"], "left_semi")


def contrast_lines(df: DataFrame) -> DataFrame:
    """Site contrast as text columns: missing axes are 0, numbers in %.8E, ordered by site."""
    padded = df.withColumns({a: F.col(a) if a in df.columns else F.lit(0.0) for a in "xyz"})
    numbers = [F.format_string("%.8E", F.col(c)).alias(c) for c in ("x", "y", "z", "intensity_re", "intensity_im")]
    return padded.select("site_id", "element", "refnumber", *numbers).orderBy("site_id")


def displacement_lines(df: DataFrame) -> DataFrame:
    """Displacements in %.6E with the frame they are in, ordered by site."""
    axes = [c for c in ("ux", "uy", "uz") if c in df.columns]
    return df.select("site_id", *(F.format_string("%.6E", F.col(c)).alias(c) for c in axes), F.lit("cartesian").alias("frame")).orderBy("site_id")


def write_lines(df: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_sites(new: DataFrame, path: str) -> None:
    """Append sites that the table does not have yet; create it if it is not there."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        new.write.parquet(path)
        return
    new.join(old.select("site_id"), "site_id", "left_anti").select(old.columns).write.mode("append").parquet(path)
