"""Transforms that factor by axis: grid points are integer triples, so a phase is a product of three small tables' entries.

With fractional coordinates ``f`` the phase of a point ``n`` is ``sum(unit[a] * n[a] * f[a])``, in any cell. Points are gathered in blocks of index
space, atoms and sites in tiles; a block and a tile need one exponential for each index of an axis and each row, and the
rest are matrix products. Where atoms share their places along the axes, as in a lattice, one axis is summed after the other. The atoms are never
broadcast by hand or held whole; grid points are, up to WHOLE of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexcols as C
from ..sources.tables import forget, stored
from .arrays import spread, sum_arrays, width
from .grids import axis_size

#: Edges of a block of grid points by the number of axes; a block holds some ten thousand points.
EDGES = {1: (4096,), 2: (128, 128), 3: (32, 32, 32)}
#: Complex cells that one intermediate matrix may have (16 bytes each).
CELLS = 1 << 21
#: Tiles of atoms up to which they are broadcast with few blocks of points (about 230 kB each at 4096 atoms).
FEW_TILES = 128
#: Grid points up to which each task has them all and holds their sums (48 bytes each).
WHOLE = 1 << 20
#: Atoms that a place of the first axis has on average, from which on atoms are dealt by it.
SHARED = 64
TWO_PI = 6.283185307179586
_SUMS = ("_a_re", "_a_im", "_o_re", "_o_im", "_d_re", "_d_im")
FIELD = ("d_re", "d_im", "av_re", "av_im")


def blocks(points: DataFrame, index: Sequence[str], carried: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Places of index space by block (and ``by``): arrays of each index column and of carried values."""
    edges = EDGES[len(index)]
    block = F.struct(*(F.floor(F.col(i) / e).alias(f"b{k}") for k, (i, e) in enumerate(zip(index, edges, strict=True))))
    return points.groupBy(*by, block.alias("_block")).agg(*(F.collect_list(F.col(c)).alias(c) for c in (*index, *carried)))


def dealt(df: DataFrame, by: Sequence[str], rows: Column, spread: Sequence[str], name: str) -> DataFrame:
    """A tile number for each row, within groups of equal ``by``, so that tiles have about ``rows`` rows each."""
    spread_by = F.xxhash64(*spread)
    if not by:
        count = df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.first(rows)), F.lit(1)).alias("_tiles"))
        return df.crossJoin(F.broadcast(count)).withColumn(name, F.pmod(spread_by, F.col("_tiles"))).drop("_tiles")
    count = df.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.first(rows)), F.lit(1)).alias("_tiles"))
    return df.join(count, list(by)).withColumn(name, F.pmod(spread_by, F.col("_tiles"))).drop("_tiles")


def _array(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _tables(numbers: Sequence[np.ndarray], units: Sequence[float], at: Sequence[np.ndarray], sign: float) -> list[np.ndarray]:
    """exp(sign i unit n f) of each axis, a row for each index."""
    return [np.exp(sign * 1j * unit * np.outer(n, f)) for n, unit, f in zip(numbers, units, at, strict=True)]


def _axes_of(places: Sequence[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Indices that occur on each axis, and where each point's are among them."""
    pairs = [np.unique(p, return_inverse=True) for p in places]
    return [n for n, _ in pairs], [at for _, at in pairs]


def _contract(tables: list[np.ndarray], weight: np.ndarray | None, at: list[np.ndarray]) -> np.ndarray:
    """sum_j w_j prod_a T_a[n_a, j] at the points: over the whole box by a matrix product, or over the points alone where they are few."""
    size, count = int(np.prod([len(t) for t in tables])), tables[0].shape[1]
    out = np.zeros(len(at[0]), complex)
    if size > 8 * len(at[0]):
        step = max(1, CELLS // len(at[0]))
        for a in range(0, count, step):
            cell = tables[0][at[0], a : a + step]
            for t, i in zip(tables[1:], at[1:], strict=True):
                cell = cell * t[i, a : a + step]
            out += cell.sum(1) if weight is None else cell @ weight[a : a + step]
        return out
    rest = int(np.prod([len(t) for t in tables[1:]]))
    box = np.zeros((len(tables[0]), rest), complex)
    step = max(1, CELLS // max(rest, 1))
    for a in range(0, count, step):
        first = tables[0][:, a : a + step]
        other = np.ones((1, first.shape[1]), complex)
        for t in tables[1:]:
            other = (other[:, None, :] * t[None, :, a : a + step]).reshape(-1, first.shape[1])
        box += (first if weight is None else first * weight[a : a + step]) @ other.T
    return box.reshape([len(t) for t in tables])[tuple(at)]


def _by_axis(tables: list[np.ndarray], of: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """sum_j w_j T_0[h, x_j] T_1[k, y_j] .. over a box of two or three axes, of atoms that are sorted by their places x, y: the last axis first, the first one last."""
    out = np.zeros([len(t) for t in tables], complex)
    first, lead = np.unique(of[0], return_index=True)
    column = _changes(*of[:-1])  # atoms that differ along the last axis alone
    head = np.flatnonzero(np.diff(column, prepend=-1))
    bound = np.append(np.searchsorted(head, lead), len(head))
    tall = max(len(head), len(tables[1]))
    step_l = max(1, min(len(tables[-1]), CELLS // tall))
    step_x = max(1, CELLS // (len(tables[1]) * step_l))
    step = max(1, CELLS // step_l)
    for n in range(0, len(tables[-1]), step_l):
        turn = np.ascontiguousarray(tables[-1][n : n + step_l].T)
        cell = np.zeros((len(head), turn.shape[1]), complex)
        for a in range(0, len(weight), step):
            some = column[a : a + step]
            starts = np.flatnonzero(np.diff(some, prepend=-1))
            cell[some[0] : some[-1] + 1] += np.add.reduceat(turn[of[-1][a : a + step]] * weight[a : a + step, None], starts)
        for x in range(0, len(first), step_x):
            part = range(x, min(len(first), x + step_x))
            if len(tables) == 3:
                made = np.stack([tables[1][:, of[1][head[bound[i] : bound[i + 1]]]] @ cell[bound[i] : bound[i + 1]] for i in part])
            else:
                made = cell[x : x + step_x]
            out[..., n : n + step_l] += np.tensordot(tables[0][:, first[x : x + step_x]], made, 1)
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that grow where a column changes from one row to the next."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _tile_sums(given: list[np.ndarray], units: list[float], r: list[np.ndarray], o: list[np.ndarray], c: np.ndarray, m: np.ndarray, rows: int) -> list[np.ndarray]:
    """The three sums at the points over atoms at r with origins o, weights c and multiplicities m."""
    numbers, at = _axes_of(given)
    box = int(np.prod([len(n) for n in numbers]))
    if len(given) > 1 and box <= 8 * len(given[0]):
        pairs, of = _axes_of([x + 1j * y for x, y in zip(r, o, strict=True)])
        if 8 * len(pairs[0]) <= len(c):
            full, origin = (_tables(numbers, units, [getattr(x, k) for x in pairs], 1.0) for k in ("real", "imag"))
            delta = [a * b.conj() for a, b in zip(full, origin, strict=True)]
            by = np.lexsort(of[::-1])
            of = [x[by] for x in of]
            return [_by_axis(t, of, w[by])[tuple(at)] for t, w in ((full, c), (origin, m), (delta, c))]
    sums = [np.zeros(len(given[0]), complex) for _ in range(3)]
    for a in range(0, len(c), rows):
        some = slice(a, a + rows)
        places, per, r_, o_ = _digits(given, units, [x[some] for x in r], [x[some] for x in o])
        numbers, at = _axes_of(places)
        full, origin = _tables(numbers, per, r_, 1.0), _tables(numbers, per, o_, 1.0)
        delta = [x * y.conj() for x, y in zip(full, origin, strict=True)]
        for s, (t, w) in zip(sums, ((full, c), (origin, m), (delta, c)), strict=True):
            s += _contract(t, w[some], at)
    return sums


def _digits(places: list[np.ndarray], units: list[float], *coordinates: list[np.ndarray]) -> tuple:
    """A single axis as two, of multiples of 64 and of what is left, so that it factors as well."""
    if len(places) > 1:
        return places, units, *coordinates
    high = places[0] // 64
    return [high, places[0] - 64 * high], [64 * units[0], units[0]], *([c[0], c[0]] for c in coordinates)


def separable_sums(atoms: DataFrame, points: DataFrame, index: Sequence[str], axes: Sequence[str], origins: Sequence[str], units: Sequence[float] | None = None, coeff: str = "coeff", by: Sequence[str] = (), atom_rows: int = 4096) -> DataFrame:
    """``index``, ``by`` and the six sums of the forward transform at each point, and the number of atoms.

    ``index`` are integer columns of ``points``, ``axes`` and ``origins`` fractional coordinates of ``atoms``; ``by`` keeps groups of atoms
    apart. Each task holds one block of points and one tile of ``atom_rows`` atoms; the sums of a block run on over the tiles that follow it, so
    they leave the task once. Points may repeat and then come once.
    """
    dims, units = len(index), list(units or [TWO_PI] * len(index))
    placed = atoms.select(*by, *(F.col(a).cast("double").alias(f"r{i}") for i, a in enumerate(axes)), *(F.col(o).cast("double").alias(f"o{i}") for i, o in enumerate(origins)), F.col(coeff).cast("double").alias("c"))
    columns = [f"{x}{i}" for x in "ro" for i in range(dims)] + ["c"]
    placed, points = stored(placed), stored(points.select(*index).distinct())
    # about how many different places there are, along the first axis and in all
    count, first, places = placed.agg(F.count(F.lit(1)), *(F.approx_count_distinct(F.xxhash64(*x)) for x in (["r0", "o0"], columns[:-1]))).first()
    shared = min(count, places) >= SHARED * first > 0
    if (shared or count > FEW_TILES * atom_rows) and points.count() <= WHOLE:
        return _whole_sums(placed, points, index, units, by, atom_rows, min(count, places), first if shared else 0)
    tile = dealt(placed, by, F.lit(atom_rows), columns, "_tile").groupBy(*by, "_tile").agg(*(F.collect_list(c).alias(c) for c in columns))
    tile, block = stored(tile), stored(blocks(points, index))
    forget(placed, points)
    schema_by = [f"`{b}` {dict(atoms.dtypes)[b]}" for b in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        key = None

        def leave() -> Iterator[pa.RecordBatch]:
            for group, (places, sums, n) in held.items():
                count = len(places[0])
                parts = [pa.array(p, pa.int32()) for p in places] + [pa.array([g] * count) for g in group]
                parts += [pa.array(x) for s in sums for x in (s.real.copy(), s.imag.copy())] + [pa.array(np.full(count, n))]
                yield pa.RecordBatch.from_arrays(parts, names=[*index, *by, *_SUMS, "_n"])
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                now = tuple(batch.column("_block")[row].as_py().values())
                if now != key:
                    yield from leave()
                    key = now
                group = tuple(batch.column(b)[row].as_py() for b in by)
                given = [_array(batch, i, row) for i in index]
                r, o = ([_array(batch, f"{x}{i}", row) for i in range(dims)] for x in "ro")
                c = _array(batch, "c", row)
                made = _tile_sums(given, units, r, o, c, np.ones(len(c)), atom_rows)
                if group in held:
                    old = held[group]
                    held[group] = (given, [a + b for a, b in zip(old[1], made, strict=True)], old[2] + len(c))
                else:
                    held[group] = (given, made, len(c))
        yield from leave()

    schema = ", ".join([*(f"`{i}` int" for i in index), *schema_by, *(f"{s} double" for s in _SUMS), "_n bigint"])
    # a block is repeated for every tile that it meets: the blocks are the streamed side
    shares = -(-16 * width(block) // max(1, block.count()))
    if shares > 1 and tile.count() <= FEW_TILES:
        # few blocks: each goes to several tasks, with a share of the tiles
        shared = block.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        pairs = spread(shared, "_block", "_share").join(F.broadcast(tile.withColumn("_share", F.pmod("_tile", F.lit(shares)))), "_share")
    else:
        pairs = spread(block, "_block").crossJoin(tile)
    parts = pairs.mapInArrow(run, schema)
    return parts.groupBy(*index, *by).agg(*(F.sum(s).alias(s) for s in (*_SUMS, "_n")))


def _whole_sums(placed: DataFrame, points: DataFrame, index: Sequence[str], units: list[float], by: Sequence[str], atom_rows: int, count: int, first: int) -> DataFrame:
    """``separable_sums`` of stored atoms and points, all points in each task: atoms come as plain rows, atoms of one place as one.

    There are about ``count`` different places. With ``first``, the number of those along the first axis, atoms are dealt by their places along the axes, so that a tile has few of them along each.
    """
    dims, kinds = len(index), dict(placed.dtypes)
    spots = [f"{x}{i}" for x in "ro" for i in range(dims)]
    given = [np.ascontiguousarray(x) for x in points.toPandas()[list(index)].to_numpy(np.int64).T] if points.count() else [np.zeros(0, np.int64)] * dims
    weight = F.sum(F.coalesce("c", F.lit(float("nan")))).alias("c"), F.count(F.lit(1)).cast("double").alias("m")
    tasks, limit = 2 * placed.sparkSession.sparkContext.defaultParallelism, atom_rows
    if first:
        limit = 16 * atom_rows
        tiles = max(1, -(-count // limit))
        along = min(tiles, first)
        across = -(-tiles // along)
        tile = F.pmod(F.xxhash64("r0", "o0"), F.lit(along)) * across + (F.pmod(F.xxhash64(*(x for x in spots if x not in ("r0", "o0"))), F.lit(across)) if dims > 1 else 0)
        rows = placed.groupBy(*by, *spots).agg(*weight).withColumn("_tile", tile).repartition(min(tiles, tasks), "_tile").sortWithinPartitions(*by, "_tile")
    else:
        # every task gives all points back
        tasks = max(tasks, min(4 * width(placed), -(-count // limit), (1 << 26) // max(1, len(given[0]))))
        rows = placed.repartition(tasks, *by, *spots).groupBy(*by, *spots).agg(*weight).withColumn("_tile", F.lit(0))
        rows = rows.sortWithinPartitions(*by) if by else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leave() -> pa.RecordBatch:
            size = len(given[0])
            parts = [pa.array(p, pa.int32()) for p in given] + [pa.array([g] * size, t) for g, t in zip(now[0], types, strict=True)]
            parts += [pa.array(x) for s in sums for x in (s.real.copy(), s.imag.copy())] + [pa.array(np.full(size, n))]
            return pa.RecordBatch.from_arrays(parts, names=[*index, *by, *_SUMS, "_n"])

        def add() -> None:
            nonlocal sums, n, size
            if size:
                x = dict(zip(names, map(np.concatenate, zip(*waiting, strict=True)), strict=True))
                made = _tile_sums(given, units, [x[f"r{i}"] for i in range(dims)], [x[f"o{i}"] for i in range(dims)], x["c"], x["m"], atom_rows)
                sums, n = made if sums is None else [a + b for a, b in zip(sums, made, strict=True)], n + int(x["m"].sum())
            waiting.clear()
            size = 0

        now, sums, n, size, waiting, types, names = None, None, 0, 0, [], [], [*spots, "c", "m"]
        for batch in batches:
            types = [batch.schema.field(b).type for b in by]
            group = list(zip(*(batch.column(b).to_pylist() for b in by), strict=True)) if by else [()] * batch.num_rows
            tile = batch.column("_tile").to_numpy()
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            cuts = [i for i in range(1, batch.num_rows) if tile[i] != tile[i - 1] or group[i] != group[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = (group[a], int(tile[a])) if a < b else now
                if now is not None and key != now:
                    add()
                    if key[0] != now[0]:
                        yield leave()
                        sums, n = None, 0
                now = key
                for at in range(a, b, atom_rows):
                    waiting.append([v[at : min(b, at + atom_rows)].copy() for v in values])
                    size += len(waiting[-1][0])
                    if size >= (4 * limit if first else limit):
                        add()
        if now is not None:
            add()
            yield leave()

    schema = ", ".join([*(f"`{i}` int" for i in index), *(f"`{b}` {kinds[b]}" for b in by), *(f"{s} double" for s in _SUMS), "_n bigint"])
    return rows.mapInArrow(run, schema).groupBy(*index, *by).agg(*(F.sum(s).alias(s) for s in (*_SUMS, "_n")))


def amplitudes_separable(atoms: DataFrame, points: DataFrame, index: Sequence[str], axes: Sequence[str], origins: Sequence[str], units: Sequence[float] | None = None, coeff: str = "coeff", atom_rows: int = 4096) -> DataFrame:
    """``index, a_re, a_im, av_re, av_im``: the amplitudes that ``scattering.amplitudes`` gives, without an exponential for each pair."""
    sums = separable_sums(atoms, points, index, axes, origins, units, coeff, (), atom_rows)
    av = C.multiply((F.col("_o_re"), F.col("_o_im")), (F.col("_d_re"), F.col("_d_im")))
    return sums.select(*index, F.col("_a_re").alias("a_re"), F.col("_a_im").alias("a_im"), (av[0] / F.col("_n")).alias("av_re"), (av[1] / F.col("_n")).alias("av_im"))


def amplitudes_by_element_separable(atoms: DataFrame, points: DataFrame, index: Sequence[str], axes: Sequence[str], origins: Sequence[str], weights: DataFrame, weight: Column, element: str = "element", units: Sequence[float] | None = None, atom_rows: int = 4096) -> DataFrame:
    """Sums by element times the form factor ``weight``, over columns of ``points`` and of ``weights`` (a row for each element); N are all atoms."""
    sums = separable_sums(atoms.withColumn("_one", F.lit(1.0)), points, index, axes, origins, units, "_one", (element,), atom_rows)
    total = F.broadcast(atoms.agg(F.count(F.lit(1)).alias("_all")))
    av = C.multiply((F.col("_o_re"), F.col("_o_im")), (F.col("_d_re"), F.col("_d_im")))
    both = sums.join(points.dropDuplicates(list(index)), list(index)).join(weights, element).crossJoin(total).withColumn("_f", weight)
    each = {"a_re": F.col("_f") * F.col("_a_re"), "a_im": F.col("_f") * F.col("_a_im"), "av_re": F.col("_f") * av[0] / F.col("_all"), "av_im": F.col("_f") * av[1] / F.col("_all")}
    return both.groupBy(*index).agg(*(F.sum(x).alias(n) for n, x in each.items()))


def axis_offsets(dist: float, step: float) -> np.ndarray:
    """Offsets of a patch along one axis, by the rule of ``grids.patch_grid``."""
    if step <= 0 or dist <= step:
        return np.zeros(1)
    n = int(np.ceil((2.0 * dist + step - 1e-8) / step))
    return -dist + np.arange(n) * step if n > 1 else np.array([-dist])


def _back(numbers: list[np.ndarray], at: list[np.ndarray], values: np.ndarray, units: list[float], centre: list[np.ndarray], offsets: list[np.ndarray]) -> np.ndarray:
    """Sums of values times exp(-i q (c + d)) over the points: (sites, values, patch points).

    The offsets of a patch are the same for all sites, so their exponentials are too. Over the box of the points one axis is
    contracted after the other; where few of its points are there, the offsets' phases of the points make one matrix.
    """
    sites, sizes = len(centre[0]), [len(d) for d in offsets]
    box, patch = [len(n) for n in numbers], int(np.prod(sizes))
    near = _tables(numbers, units, centre, -1.0)  # indices x sites
    shift = _tables(numbers, units, offsets, -1.0)  # indices x offsets
    rest = int(np.prod(box[1:]))
    whole = sizes[0] * box[0] * rest + sizes[0] * int(np.prod(sizes[1:])) * rest
    out = np.zeros((sites, len(values), patch), complex)
    if whole > len(at[0]) * patch:
        step_p = max(1, CELLS // len(at[0]))
        step_s = max(1, CELLS // (len(at[0]) * len(values)))
        grid = np.unravel_index(np.arange(patch), sizes)
        for p in range(0, patch, step_p):
            turn = np.ones((len(at[0]), len(grid[0][p : p + step_p])), complex)
            for t, i, g in zip(shift, at, grid, strict=True):
                turn = turn * t[np.ix_(i, g[p : p + step_p])]
            for s in range(0, sites, step_s):
                cell = np.ones((len(at[0]), len(centre[0][s : s + step_s])), complex)
                for t, i in zip(near, at, strict=True):
                    cell = cell * t[i, s : s + step_s]
                out[s : s + step_s, :, p : p + step_p] = (cell.T[:, None, :] * values[None]) @ turn
        return out
    dense = np.zeros((len(values), *box), complex)
    dense[(slice(None), *at)] = values
    first = np.moveaxis(dense, 1, 0).reshape(box[0], -1)  # first axis x (values, other axes)
    step_s = max(1, CELLS // (sizes[0] * max(box[0], len(values) * rest)))
    step_p = max(1, CELLS // max(box[0], len(values) * rest))
    for s in range(0, sites, step_s):
        some = slice(s, s + step_s)
        count = len(centre[0][some])
        for p in range(0, sizes[0], step_p):
            part = shift[0][:, p : p + step_p]
            turn = near[0][:, some].T[:, None, :] * part.T[None]  # sites, offsets, indices
            done = (turn.reshape(-1, box[0]) @ first).reshape(count, part.shape[1], len(values), *box[1:])
            for k in range(1, len(box)):  # the axis to contract is the fourth, its offsets go last
                turn = (near[k][:, some].T[:, None, :] * shift[k].T[None]).transpose(0, 2, 1)  # sites, indices, offsets
                tail = np.moveaxis(done, 3, -1)
                shape = tail.shape
                done = np.matmul(tail.reshape(count, -1, shape[-1]), turn).reshape(*shape[:-1], sizes[k])
            done = np.moveaxis(done, 2, 1).reshape(count, len(values), -1)
            width = patch // sizes[0]
            out[some, :, p * width : (p + part.shape[1]) * width] = done
    return out


def _site_tiles(sites: DataFrame, axes: Sequence[str], by: Sequence[str], cells: int) -> DataFrame:
    """Sites of one patch and one ``by`` in tiles of about ``cells`` patch points: arrays, under a ``_key`` of their own."""
    dims = len(axes)
    points = F.lit(1).cast("bigint")
    for i in range(dims):
        points = points * axis_size(F.col("dist")[i], F.col("step")[i])
    placed = sites.select(*by, "site_id", *(F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate(axes)), F.col("dist").cast("array<double>").alias("dist"), F.col("step").cast("array<double>").alias("step"))
    group = (*by, "dist", "step")
    tiled = dealt(placed, group, F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.lit(cells) / points))), ["site_id"], "_tile")
    columns = ["site_id", *(f"p{i}" for i in range(dims))]
    # sorted, so that a tile that is computed again has its sites in the same order
    tile = tiled.groupBy(*group, "_tile").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_s"))
    return tile.select(*group, *(F.col(f"_s.{c}").alias(c) for c in columns), F.to_json(F.struct(*group, "_tile")).alias("_key"))


def _patch_sums(pairs: DataFrame, index: Sequence[str], units: Sequence[float], tags: Sequence[str]) -> DataFrame:
    """``tags, site_id`` and the field's arrays from pairs of a tile of sites and a block of amplitudes.

    The sums of a tile run on over the blocks that follow it with equal tags; where its blocks came in several runs, the partial sums are
    arrays, one row for each tile and run, that are added up one after another.
    """
    dims, kinds = len(index), dict(pairs.dtypes)
    tagged = [f"`{t}` {kinds[t]}" for t in tags]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sums = None

        def leave() -> pa.RecordBatch:
            flat = [x for v in (0, 1) for x in (sums[:, v].real, sums[:, v].imag)]
            made = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in flat]
            return pa.RecordBatch.from_arrays([*now[1], *made], names=["_key", *tags, "_sites", *FIELD])

        for batch in batches:
            for row in range(batch.num_rows):
                name = tuple(batch.column(c)[row].as_py() for c in ("_key", *tags))
                if now is None or name != now[0]:
                    if now is not None:
                        yield leave()
                    now, sums = (name, [batch.column(c).slice(row, 1) for c in ("_key", *tags, "site_id")]), None
                a, av = (_array(batch, f"{x}_re", row) + 1j * _array(batch, f"{x}_im", row) for x in ("a", "av"))
                centre = [_array(batch, f"p{i}", row) for i in range(dims)]
                offsets = [axis_offsets(d, s) for d, s in zip(_array(batch, "dist", row), _array(batch, "step", row), strict=True)]
                numbers, at = _axes_of([_array(batch, i, row) for i in index])
                made = _back(numbers, at, np.stack([a - av, av]), units, centre, offsets[:dims])
                sums = made if sums is None else sums + made
        if now is not None:
            yield leave()

    arrays = ", ".join(f"{f} array<double>" for f in FIELD)
    parts = pairs.mapInArrow(run, ", ".join(["_key string", *tagged, "_sites array<bigint>", arrays]))
    summed = sum_arrays(parts, ["_key", *tags, "_sites"], FIELD)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = _array(batch, "_sites", row)
                rows = [pa.array(list(_array(batch, f, row).reshape(len(ids), -1)), pa.list_(pa.float64())) for f in FIELD]
                same = [pa.array([batch.column(t)[row].as_py()] * len(ids), batch.column(t).type) for t in tags]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ids), *rows], names=[*tags, "site_id", *FIELD])

    return summed.mapInArrow(split, ", ".join([*tagged, "site_id bigint", arrays]))


_VALUES = ("a_re", "a_im", "av_re", "av_im")


def residual_patches(ampl: DataFrame, sites: DataFrame, index: Sequence[str], axes: Sequence[str], units: Sequence[float] | None = None, cells: int = 1 << 18) -> DataFrame:
    """``site_id, d_re, d_im, av_re, av_im``: the residual field on each site's patch, an array in the order of ``point_no``.

    ``sites`` have ``site_id``, the centre's fractional coordinates ``axes``, ``dist`` and ``step``. Tiles hold sites of one patch, about ``cells`` patch
    points each, so a site's patch is never gathered from single points. Without amplitudes to add there are no rows.
    """
    units = list(units or [TWO_PI] * len(index))
    block = blocks(ampl.select(*index, *(F.col(v).cast("double").alias(v) for v in _VALUES)), index, _VALUES)
    pairs = spread(_site_tiles(sites, axes, (), cells), "_key").crossJoin(block)
    return _patch_sums(pairs, index, units, ())


def residual_partials(ampl: DataFrame, sites: DataFrame, pending: DataFrame, index: Sequence[str], axes: Sequence[str], units: Sequence[float] | None = None, cells: int = 1 << 18) -> DataFrame:
    """``interval_id, chunk_id, site_id`` and the field's arrays: what each pending pair of an interval and a chunk of sites adds.

    Only tiles and blocks of pending pairs (``interval_id, chunk_id``) meet, by equality joins; ``ampl`` has ``interval_id``, ``sites`` have ``chunk_id``.
    """
    units = list(units or [TWO_PI] * len(index))
    gathered = ampl.select("interval_id", *index, *(F.col(v).cast("double").alias(v) for v in _VALUES))
    block = blocks(gathered, index, _VALUES, ("interval_id",))
    tile = _site_tiles(sites, axes, ("chunk_id",), cells)
    pairs = spread(tile.join(pending.select("interval_id", "chunk_id"), "chunk_id"), "_key", "interval_id").join(block, "interval_id")
    return _patch_sums(pairs, index, units, ("interval_id", "chunk_id"))


def patch_rows(field: DataFrame, sites: DataFrame, axes: Sequence[str]) -> DataFrame:
    """The field of ``residual_patches`` as a row for each patch point: ``site_id, point_no, p<axis>`` and the four values."""
    joined = field.join(sites.select("site_id", *axes, "dist", "step"), "site_id")
    out = joined.select("site_id", *axes, "dist", "step", F.posexplode(F.arrays_zip(*FIELD)).alias("point_no", "_v"))
    left = F.col("point_no")
    for i, a in reversed(list(enumerate(axes))):
        d, s = F.col("dist")[i], F.col("step")[i]
        n = axis_size(d, s)
        at = F.pmod(left, n)
        left = F.floor(left / n)
        out = out.withColumn(f"p{a}", F.col(a) + F.when(n == 1, F.when((s <= 0) | (d <= s), 0.0).otherwise(-d)).otherwise(-d + at * s))
    return out.select("site_id", F.col("point_no").cast("bigint").alias("point_no"), *(f"p{a}" for a in axes), *(F.col(f"_v.{f}").alias(f) for f in FIELD))
