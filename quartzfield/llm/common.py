"""Helpers shared by the text operators: shared storage, table reading and batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words and that exact dedup ignores.
WHITESPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables; the path may be any that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Only a session on one machine gets one of its own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quartzfield-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage and survives lost executors.

    The shuffle files of that job go when it ends; else they stay until the driver's next garbage collection.
    """
    path, conf, clean = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}", df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean)
    conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(clean, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text at most (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
