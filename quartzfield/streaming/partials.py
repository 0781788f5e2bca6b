"""Partial sums that arrive as files, added up as a stream: duplicates count once, the running table is complete after each batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_partials(spark: SparkSession, path: str, schema: str, key: Sequence[str], part: Sequence[str], values: Sequence[str], arrived: str | None = None, late: str = "1 day") -> DataFrame:
    """Streaming sums by key of the Parquet parts in a folder; a part delivered twice is dropped.

    With ``arrived``, a time column, the parts seen are forgotten ``late`` behind the newest one, so the state stays bounded; without it all are remembered.
    """
    parts = spark.readStream.schema(schema).parquet(path)
    once = parts.withWatermark(arrived, late).dropDuplicatesWithinWatermark([*key, *part]) if arrived else parts.dropDuplicates([*key, *part])
    return once.groupBy(*key).agg(*(F.sum(v).alias(v) for v in values))


def run_available(sums: DataFrame, table: str, checkpoint: str, keep: int = 3) -> StreamingQuery:
    """Add what has arrived and stop; the next run goes on from the checkpoint.

    Each batch is a version of its own, so readers keep what they read; of complete versions the newest ``keep`` stay, older ones are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/version={number}")
        jvm, conf = batch.sparkSession._jvm, batch.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(table)
        files = folder.getFileSystem(conf)
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("version=") and int(name.removeprefix("version=")) <= number - keep:
                files.delete(status.getPath(), True)

    return sums.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest complete version of the running table."""
    every = spark.read.parquet(table)
    newest = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == newest).drop("version")
