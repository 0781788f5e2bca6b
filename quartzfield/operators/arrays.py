"""Rows of arrays: dealing them to tasks, and their sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def width(df: DataFrame) -> int:
    """Tasks for work that is large for its bytes: as many as a shuffle has, at least one for each core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to four times that many tasks, as rows take different time. The number is given, so that Spark does not join tasks because their bytes are few."""
    return df.repartition(4 * width(df), *keys)


def sum_arrays(df: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``key`` and, for each of its groups, the sums of the array columns ``values``, place by place (arrays of a group are equally long).

    Rows of a key come one after another, so a task holds one group's sums and one row at a time, however many rows there are.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def leave() -> pa.RecordBatch:
            made = [pa.array([s], pa.list_(pa.float64())) for s in sums]
            return pa.RecordBatch.from_arrays([*now[1], *made], names=[*key, *values])

        for batch in batches:
            for row in range(batch.num_rows):
                name = tuple(batch.column(k)[row].as_py() for k in key)
                found = [batch.column(v)[row].values.to_numpy(zero_copy_only=False) for v in values]
                if now is None or name != now[0]:
                    if now is not None:
                        yield leave()
                    now = (name, [batch.column(k).slice(row, 1) for k in key])
                    sums = [np.array(f) for f in found]
                else:
                    for s, f in zip(sums, found, strict=True):
                        s += f
        if now is not None:
            yield leave()

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *(f"`{v}` array<double>" for v in values)])
    return df.select(*key, *values).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)
