"""Periodic lattices in blocks with replicated borders: stencils within a block, one shuffle for all their offsets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least edge of a block by the number of axes.
EDGE = {1: 16384, 2: 128, 3: 32}


def _blocks_of(n: int, reach: int, edge: int) -> int:
    """Blocks along an axis of ``n`` cells; none is narrower than the reach."""
    return max(1, n // max(edge, reach, 1))


def _places(g: Column, n: int, reach: int, edge: int) -> Column:
    """Blocks along one axis that see a cell: ``b``, its place ``x`` from the block's start, and whether the block is its ``own``."""
    count = _blocks_of(n, reach, edge)

    def place(b: Column, x: Column, own: bool) -> Column:
        return F.struct(b.cast("int").alias("b"), x.cast("int").alias("x"), F.lit(own).alias("own"))

    if count == 1:
        images = -(-reach // n)
        seen = F.array(*(place(F.lit(0), g + k * n, k == 0) for k in range(-images, images + 1)))
        return F.filter(seen, lambda p: (p.x >= -reach) & (p.x < n + reach))

    def start(b: Column) -> Column:
        return F.floor(b * n / count)

    b = F.floor(((g + 1) * count - 1) / n)
    left, right = F.pmod(b - 1, F.lit(count)), F.pmod(b + 1, F.lit(count))
    into, back = g - start(b), g - start(b + 1)
    own = F.array(place(b, into, True))
    before = F.when(into < reach, F.array(place(left, start(left + 1) - start(left) + into, False))).otherwise(F.array().cast("array<struct<b:int,x:int,own:boolean>>"))
    after = F.when(back >= -reach, F.array(place(right, back, False))).otherwise(F.array().cast("array<struct<b:int,x:int,own:boolean>>"))
    return F.concat(own, before, after)


def in_blocks(df: DataFrame, grid: Sequence[str], size: Sequence[int], reach: int, edge: int | None = None) -> DataFrame:
    """Rows with ``_block``, ``_x0, _x1, ...`` and ``_own``: each in its block, and again in every block whose border it lies within ``reach`` of."""
    edge = edge or EDGE[len(grid)]
    out, own = df, F.lit(True)
    for i, (g, n) in enumerate(zip(grid, size, strict=True)):
        out = out.withColumn(f"_p{i}", F.explode(_places(F.col(g), n, reach, edge))).withColumn(f"_x{i}", F.col(f"_p{i}.x"))
        own = own & F.col(f"_p{i}.own")
    dims = range(len(grid))
    return out.withColumn("_own", own).withColumn("_block", F.struct(*(F.col(f"_p{i}.b").alias(f"b{i}") for i in dims))).drop(*(f"_p{i}" for i in dims))


def _starts(size: Sequence[int], reach: int, edge: int) -> list[np.ndarray]:
    return [np.array([b * n // c for b in range(c + 1)]) for n in size for c in [_blocks_of(n, reach, edge)]]


def periodic_neighbours(df: DataFrame, grid: Sequence[str], size: Sequence[int], offsets: Sequence[Sequence[int]], values: Sequence[str], edge: int | None = None) -> DataFrame:
    """Each row with those that stand at the given lattice offsets, the lattice being periodic: neighbour columns ``n_<value>``.

    Cells may be empty or hold several rows. Rows are shuffled once, to their block, with copies of those at borders; all offsets are looked up there.
    """
    reach = max(abs(o) for offset in offsets for o in offset)
    edge = edge or EDGE[len(grid)]
    dims, columns = range(len(grid)), list(df.columns)
    strides = [1]
    for starts in reversed(_starts(size, reach, edge)[1:]):
        strides.insert(0, strides[0] * int(np.diff(starts).max() + 2 * reach))
    kinds = dict(df.dtypes)

    def look(rows: pa.Table) -> pa.Table:
        at = sum((rows.column(f"_x{i}").to_numpy().astype(np.int64) + reach) * strides[i] for i in dims)
        order = np.argsort(at, kind="stable")
        sorted_at, own = at[order], np.flatnonzero(rows.column("_own").to_numpy())
        mine, theirs = [], []
        for offset in offsets:
            wanted = at[own] + sum(o * s for o, s in zip(offset, strides, strict=True))
            low, high = np.searchsorted(sorted_at, wanted, "left"), np.searchsorted(sorted_at, wanted, "right")
            count = high - low
            mine.append(np.repeat(own, count))
            theirs.append(order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))])
        one, two = rows.select(columns).take(np.concatenate(mine)), rows.select(values).take(np.concatenate(theirs))
        return pa.table([*one.columns, *two.columns], names=[*columns, *(f"n_{v}" for v in values)])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"`n_{v}` {kinds[v]}" for v in values)])
    placed = in_blocks(df, grid, size, reach, edge)
    return placed.groupBy("_block").applyInArrow(look, schema)


def smoothed(df: DataFrame, grid: Sequence[str], size: Sequence[int], value: str, weights: Sequence[tuple[int, float]], edge: int | None = None) -> DataFrame:
    """``grid, value``: the weights' sums over every axis one after another, for all cells that a value reaches; the lattice is periodic."""
    reach = max(abs(o) for o, _ in weights)
    edge = edge or EDGE[len(grid)]
    starts = _starts(size, reach, edge)
    dims, kinds = range(len(grid)), dict(df.dtypes)

    def spread(key: tuple, rows: pa.Table) -> pa.Table:
        at = list(key[0].as_py().values())
        lengths = [int(starts[i][b + 1] - starts[i][b]) for i, b in enumerate(at)]
        cell = tuple(rows.column(f"_x{i}").to_numpy() + reach for i in dims)
        sums, there = np.zeros([n + 2 * reach for n in lengths]), np.zeros([n + 2 * reach for n in lengths])
        np.add.at(sums, cell, rows.column(value).to_numpy())
        np.add.at(there, cell, 1.0)
        for i in dims:
            def over(a: np.ndarray, factor: bool, axis: int = i) -> np.ndarray:
                n = a.shape[axis] - 2 * reach
                return sum(np.take(a, np.arange(reach - o, reach - o + n), axis) * (w if factor else 1.0) for o, w in weights)

            sums, there = over(sums, True), over(there, False)
        found = np.nonzero(there)
        places = [pa.array(f + starts[i][at[i]]) for i, f in enumerate(found)]
        return pa.table([*places, pa.array(sums[found])], names=[*grid, value])

    placed = in_blocks(df.select(*grid, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()), grid, size, reach, edge)
    out = placed.groupBy("_block").applyInArrow(spread, ", ".join([*(f"`{g}` bigint" for g in grid), f"`{value}` double"]))
    return out.select(*(F.col(g).cast(kinds[g]).alias(g) for g in grid), value)
