"""Suffix-array dedup on bytes: common-prefix interval trees over anchored suffixes find maximal repeats with all occurrences.

Suffixes that start at equal anchors are dealt to tasks together (``segments``). In a task their sorted order and common
prefixes form an enhanced suffix array; a stack scan lists its common-prefix intervals from the leaves up, and the intervals' members, in the order of
what stands before them, are merged on the way. What neighbours in that order share tells how far each repeat extends to the left and
whether its left extensions are diverse. Pieces of repeats with the same places are joined to whole ones in each document.
"""

from __future__ import annotations

import uuid
from bisect import bisect
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices
from .segments import branching, byte_symbols, documents, keyed, repeated_segments, segment_texts, unpack

_KEY = ["c1", "c2"]
_PLACES = ["n", "low", "high", "bits", "mixed"]
_REPEAT = "array<struct<left:int,right:int,n:bigint,low:bigint,high:bigint,bits:bigint,mixed:bigint>>"
_REPEATS = pa.list_(pa.struct([("left", pa.int32()), ("right", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("bits", pa.int64()), ("mixed", pa.int64())]))


class Side:
    """Texts compared from their start: sorted order and common prefix of two of them."""

    def __init__(self, texts: list[bytes]):
        self.size = list(map(len, texts))
        self.width = max(self.size, default=0)
        self.number = [int.from_bytes(t.ljust(self.width, b"\0"), "big") for t in texts]

    def common(self, a: int, b: int) -> int:
        differ = (self.number[a] ^ self.number[b]).bit_length()
        return min(self.width - (differ + 7) // 8, self.size[a], self.size[b])

    def order(self, some: list[int]) -> list[int]:
        return sorted(some, key=lambda i: (self.number[i], self.size[i]))


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each common-prefix interval of at least ``least`` symbols; lcp[i] is that of i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, n in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            yield length, first, i
        if n >= least and (not stack or stack[-1][0] < n):
            stack.append((n, first))


#: Added to how far a repeat reaches to a side where all segments that hold it end, so that these alone do not tell whether it goes on alike.
_OPEN = 1 << 16

#: Where a content stands: number of places, smallest and largest key of their documents, one bit for each of 64 hashes of those, and all combined.
Places = tuple[int, int, int, int, int]


def together(a: Places, b: Places) -> Places:
    return a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] | b[3], a[4] ^ b[4]


def maximal_repeats(contents: list[bytes], anchors: list[int], window: int, places: list[Places]) -> list[tuple[int, int, list[tuple[int, int, Places]]]]:
    """For each text with an anchor: how far repeats of ``window`` bytes or more reach left and right of it (0, 0: none), and the repeats.

    A repeat is (bytes left of the anchor, bytes from the anchor on, its places); it cannot be extended to
    either side without losing an occurrence. All texts share the bytes at their anchors and are different. Where all texts with the repeat end with it on a
    side, _OPEN is added there. Where only some do, these go on otherwise (a window that goes on alike would have the same anchor), so the repeat is whole there.
    """
    right = Side([c[a:] for c, a in zip(contents, anchors, strict=True)])
    left = Side([c[:a][::-1] for c, a in zip(contents, anchors, strict=True)])
    order, behind = right.order(list(range(len(contents)))), left.order(list(range(len(contents))))
    rank = {x: i for i, x in enumerate(behind)}
    lcp = [right.common(a, b) for a, b in zip(order, order[1:], strict=False)]
    reach, repeats = [[0, 0] for _ in contents], [[] for _ in contents]
    merged: dict[int, tuple[int, list[int]]] = {}  # first suffix of an interval: its last one, its members by what stands before them
    for length, first, last in prefix_intervals(lcp, 1):
        parts, at = [], first
        while at <= last:
            end, members = merged.pop(at, (at, [rank[order[at]]]))
            parts.append(members)
            at = end + 1
        parts.sort(key=len)
        came = {x: i for i, part in enumerate(parts) for x in part}
        if 4 * sum(map(len, parts[:-1])) < len(parts[-1]):  # few join many
            inside = parts[-1]
            for x in chain.from_iterable(parts[:-1]):
                inside.insert(bisect(inside, x), x)
        else:
            inside = sorted(chain.from_iterable(parts))
        merged[first] = last, inside
        shared = [left.common(behind[a], behind[b]) for a, b in zip(inside, inside[1:], strict=False)]
        for a, b, n in zip(inside, inside[1:], shared, strict=False):
            if n + length >= window:
                for x in (behind[a], behind[b]):
                    reach[x][0], reach[x][1] = max(reach[x][0], n), max(reach[x][1], length)
        for n, a, b in prefix_intervals(shared, max(0, window - length)):
            if len({came[x] for x in inside[a : b + 1]}) == 1:
                continue  # all of them go on alike to the right: found with the longer prefix
            some = [behind[x] for x in inside[a : b + 1]]
            all_places = places[some[0]]
            for x in some[1:]:
                all_places = together(all_places, places[x])
            one = n if any(left.size[x] > n for x in some) else n | _OPEN, length if any(right.size[x] > length for x in some) else length | _OPEN, all_places
            for x in some:
                repeats[x].append(one)
    for x, at in enumerate(places):  # copies of one text, unless another one holds it too
        if at[0] > 1 and (left.size[x], right.size[x]) not in {(a & ~_OPEN, b & ~_OPEN) for a, b, _ in repeats[x]}:
            repeats[x].append((left.size[x] | _OPEN, right.size[x] | _OPEN, at))
    return [(a, b, r) for (a, b), r in zip(reach, repeats, strict=True)]


_FAR = np.int64(1) << 40  # longer than any text
_SPANS = 1 << 16  # extended at once
_TASK_PIECES = 1 << 18  # of the documents of a task, which come in one batch


def _runs(group: np.ndarray, start: np.ndarray, end: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of spans that share ``overlap`` symbols with those before, and where the run ends. Sorted by group (0, 1, ...) and start."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reached = np.maximum.accumulate(end + group * _FAR)
    first = np.flatnonzero(np.concatenate(([True], start[1:] + group[1:] * _FAR > reached[:-1] - overlap)))
    return first, np.maximum.reduceat(end, first)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that grow where a column changes from one row to the next."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def removed_runs(doc: np.ndarray, spans: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the maximal runs that the spans with ``gone`` cover."""
    some = np.flatnonzero(spans["gone"])
    some = some[np.lexsort((spans["start"][some], doc[some]))]
    first, end = _runs(doc[some], spans["start"][some], spans["end"][some], 0)
    return doc[some][first], spans["start"][some][first], end


def whole_repeats(doc: np.ndarray, spans: dict[str, np.ndarray], window: int) -> np.ndarray:
    """Rows (doc, start, end, places) of the maximal repeats of some documents.

    A repeat that is whole on both sides is one as it stands. One that is open on a side reaches on over each piece there that stands at all of its places too
    and shares all but one byte of a window with it. Places are told by
    their number, the smallest and largest document key, one bit for each of 64 hashes that occurs, and the combination of all keys.
    """
    order = np.flatnonzero(spans["n"] > 1)
    start, end, of = spans["start"][order], spans["end"][order], doc[order]
    whole = ~(spans["open_left"][order] | spans["open_right"][order])
    made = np.stack((of[whole], start[whole], end[whole], spans["n"][order[whole]]), axis=1)
    if whole.all():
        return _distinct(made)
    some = order[~whole | np.isin(spans["mixed"][order], spans["mixed"][order[~whole]])]
    pieces = _joined(doc, spans, some, window)
    rest = order[whole & ~np.isin(order, some)]
    own = {"doc": doc[rest], **{c: spans[c][rest] for c in pieces if c != "doc"}}
    pieces = {c: np.concatenate((x, own[c])) for c, x in pieces.items()}
    by = np.lexsort((pieces["end"], pieces["start"], pieces["doc"]))
    return _distinct(np.concatenate((made, _extended({c: x[by] for c, x in pieces.items()}, window))))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted rows, each once."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate((np.ones(len(rows[:1]), bool), (rows[1:] != rows[:-1]).any(axis=1)))]


def _joined(doc: np.ndarray, spans: dict[str, np.ndarray], order: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Some pieces, those with the same places that share all but one byte of a window as one; a side is open if all that reach as far are open there."""
    start, end, gone = spans["start"], spans["end"], spans["gone"]
    order = order[np.lexsort((gone[order], end[order], start[order], doc[order]))]
    # of a segment's copies, what its suffixes say of it counts instead
    same = _changes(doc[order], start[order], end[order])
    told = ~gone[order][np.searchsorted(same, same)]
    order = order[~(gone[order] & told)]
    order = order[np.lexsort((start[order], *(spans[c][order] for c in _PLACES), doc[order]))]
    start, end, group = start[order], end[order], _changes(doc[order], *(spans[c][order] for c in _PLACES))
    first, last = _runs(group, start, end, window - 1)
    size = np.diff(first, append=len(order))
    open_left = np.logical_and.reduceat(spans["open_left"][order] | (start > np.repeat(start[first], size)), first)
    open_right = np.logical_and.reduceat(spans["open_right"][order] | (end < np.repeat(last, size)), first)
    at = order[first]
    return {"doc": doc[at], "start": start[first], "end": last, "open_left": open_left, "open_right": open_right, **{c: spans[c][at] for c in _PLACES}}


def _extended(pieces: dict[str, np.ndarray], window: int) -> np.ndarray:
    """Rows (doc, start, end, places) of pieces sorted by document and start, each as far as pieces with all of its places lead from its open sides."""
    doc, places, open_left, open_right = pieces["doc"], [pieces[c] for c in _PLACES], pieces["open_left"], pieces["open_right"]
    start, end = pieces["start"] + doc * _FAR, pieces["end"] + doc * _FAR
    last, some = end.copy(), np.flatnonzero(open_right)
    last[some] = _led(start, end, places, some, window)
    by = np.flatnonzero(open_left | open_right)
    by = by[np.lexsort((by, *(c[by] for c in places), doc[by]))]
    kept = ~(open_left | open_right)
    kept[by[_runs(_changes(doc[by], *(c[by] for c in places)), pieces["start"][by], last[by] - doc[by] * _FAR, window - 1)[0]]] = True
    kept = np.flatnonzero(kept | ~open_left)  # else an earlier piece with the same places leads over it
    first, some = start[kept], open_left[kept]
    by = np.argsort(-end, kind="stable")
    where = np.empty_like(by)
    where[by] = np.arange(len(by))
    first[some] = -_led(-end[by], -start[by], [c[by] for c in places], where[kept[some]], window)
    return np.stack((doc[kept], first - doc[kept] * _FAR, last[kept] - doc[kept] * _FAR, pieces["n"][kept]), axis=1)


def _led(start: np.ndarray, end: np.ndarray, places: list[np.ndarray], some: np.ndarray, window: int) -> np.ndarray:
    """How far ``some`` spans reach by those after them (sorted by start) that have all of their places and share all but one symbol of a window with what is reached.

    Of a range of candidates the one that ends last is tried first (range maxima in a sparse table): where it has all of the places the others need
    no look, and what it reaches itself is reached too; else both sides of it are tried, as far as they end beyond what is reached.
    """
    n, low, high, bits, _ = places
    without, reached = ~bits, end.copy()
    by = np.argsort(end, kind="stable")
    most = np.zeros((int(np.diff(np.flatnonzero(np.diff(start // _FAR, prepend=-_FAR, append=_FAR))).max(initial=1)).bit_length(), len(by)), np.int32)
    most[0][by] = np.arange(len(by))
    for k in range(1, len(most)):
        half, size = 1 << k - 1, max(0, len(by) - (1 << k) + 1)
        np.maximum(most[k - 1, :size], most[k - 1, half : half + size], out=most[k, :size])
    stop = np.maximum(np.arange(len(end)) + 1, np.searchsorted(start, end - window + 1, "right"))
    later = np.sort(some)[::-1]
    for at in range(0, len(later), _SPANS):
        mine = later[at : at + _SPANS]
        first, last = mine + 1, stop[mine]
        while len(mine):
            few = last > first
            mine, first, last = mine[few], first[few], last[few]
            level = np.frexp(last - first)[1] - 1
            other = by[np.maximum(most[level, first], most[level, last - (1 << level)])]
            few = end[other] > reached[mine]
            mine, first, last, other = mine[few], first[few], last[few], other[few]
            good = (bits[mine] & without[other] == 0) & (n[other] >= n[mine]) & (low[other] <= low[mine]) & (high[other] >= high[mine])
            bad, grown = ~good, mine[good]
            np.maximum.at(reached, grown, reached[other[good]])
            grown = np.unique(grown)
            old, stop[grown] = stop[grown], np.searchsorted(start, reached[grown] - window + 1, "right")
            mine, first, last = np.concatenate((mine[bad], mine[bad], grown)), np.concatenate((first[bad], other[bad] + 1, old)), np.concatenate((other[bad], last[bad], stop[grown]))
    return reached[some]


def _batch(out: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _halves(first: str, last: str) -> Column:
    """Both halves (a, b) of the numbers from one column to another; a single number stays."""
    a, b = F.col(first), F.col(last)
    middle = F.floor((a + b) / 2).cast("int")
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    return F.when(a == b, F.array(pair(a, b))).otherwise(F.array(pair(a, middle), pair(middle + 1, b)))


class RepeatFinder:
    """The jobs of one search: segments with repeated anchors, and what their suffixes share."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, window: int, gram: int, group_rows: int):
        self.rows, self.window, self.gram, self.group_rows = keyed(df, id_col, text_col), window, gram, group_rows
        self.segments = repeated_segments(self.rows, byte_symbols, window, gram)
        where = [F.count(F.lit(1)).alias("n"), F.min("kid").alias("low"), F.max("kid").alias("high"), F.bit_or(F.expr("shiftleft(1L, CAST(kid & 63 AS INT))")).alias("bits"), F.bit_xor(F.xxhash64("kid")).alias("mixed")]
        self.unique = self.segments.groupBy(*_KEY).agg(*where, F.min("g").alias("g"), F.min("kid").alias("kid"), F.min_by("at", "kid").alias("at"))
        self.forks = materialise(branching(self.unique))
        few, many = (self.forks.where(c).drop("variants") for c in (F.col("variants") <= group_rows, F.col("variants") > group_rows))
        whole = self._suffixes(few).withColumns({"group": F.col("g"), "l1": F.lit(window), "r1": F.lit(window)})
        found = self._compared(whole, [(c, pa.int64()) for c in _KEY])
        parts = [] if many.isEmpty() else self._by_cells(many)
        for part in parts:
            found = found.unionByName(part)
        reach = materialise(found)
        self.told = materialise(self.unique.where("n > 1").select(*_KEY, *_PLACES).join(reach, _KEY, "full").select(*_KEY, *(F.coalesce(c, F.lit(1)).alias(c) for c in _PLACES), "repeats"))
        discard(*parts, self.forks, reach)

    def _suffixes(self, wanted: DataFrame) -> DataFrame:
        """``g, c1, c2``, the places, and the bytes before the anchor (last one first) and from it on, of each wanted segment."""
        window = self.window
        numbers = ("g", *_KEY, *_PLACES)

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for batch in slices(batches, "text"):
                for text, some in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    raw = text.encode()
                    for w in some:
                        start, windows, anchor = unpack(w["at"])
                        out.append((*(w[c] for c in numbers), raw[start : start + anchor][::-1], raw[start + anchor : start + windows - 1 + window]))
                        if len(out) == 10_000:
                            yield _batch(out, kinds)
                            out = []
            yield _batch(out, kinds)

        kinds = [*((c, pa.int64()) for c in numbers), ("left", pa.binary()), ("right", pa.binary())]
        return segment_texts(self.rows, wanted, fetch, ", ".join(f"{c} bigint" for c in numbers) + ", left binary, right binary")

    def _compared(self, suffixes: DataFrame, ids: list[tuple[str, pa.DataType]]) -> DataFrame:
        """``ids`` and ``repeats`` of suffixes: one task holds all that share a ``group``. Repeats of more than ``l1`` bytes left or ``r1`` right of the anchor are left out."""
        window, names, kinds = self.window, [n for n, _ in ids], [*ids, ("repeats", _REPEATS)]

        def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
            group: list[tuple] = []
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in fields]
                for row in zip(*columns, strict=True):
                    if group and group[0][0] != row[0]:
                        yield group
                        group = []
                    group.append(row)
            if group:
                yield group

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for group in groups(batches):
                if len(group) > 1:
                    l1, r1 = group[0][1:3]
                    found = maximal_repeats([r[3][::-1] + r[4] for r in group], [len(r[3]) for r in group], window, [r[5:10] for r in group])
                    for row, (_, _, repeats) in zip(group, found, strict=True):
                        kept = [{"left": a, "right": b, **dict(zip(_PLACES, at, strict=True))} for a, b, at in repeats if a & ~_OPEN <= l1 and b & ~_OPEN <= r1]
                        if kept:
                            out.append((*row[10:], kept))
                if len(out) >= 5_000:
                    yield _batch(out, kinds)
                    out = []
            yield _batch(out, kinds)

        fields = ("group", "l1", "r1", "left", "right", *_PLACES, *names)
        dealt = suffixes.select(*dict.fromkeys(fields)).repartition("group").sortWithinPartitions("group")
        return dealt.mapInArrow(compare, ", ".join(f"{n} {'binary' if k == pa.binary() else 'bigint'}" for n, k in ids) + f", repeats {_REPEAT}")

    def _by_cells(self, wanted: DataFrame) -> list[DataFrame]:
        """``c1, c2, repeats`` (several rows for a segment) of anchors with more suffixes than a task may hold.

        The repeats are told apart by how far they reach from the anchor: a cell takes those of l0 to l1 bytes left and r0 to r1 right of it. They
        are found among the suffixes that share the l0 and r0 bytes next to the anchor, and one byte beyond l1 and r1 tells whether they end there, so
        suffixes that are alike up to there count as one. What is still too many is halved both ways; where l0 = l1 and
        r0 = r1 there are 257 * 257 different ones at most.
        """
        cell = ["g", "l0", "l1", "r0", "r1", "near_left", "near_right"]
        places = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("bits").alias("bits"), F.bit_xor("mixed").alias("mixed")]
        bounds = {"l0": F.lit(0), "l1": F.lit(self.window - self.gram), "r0": F.lit(1), "r1": F.lit(self.window)}
        open_, out = materialise(self._suffixes(wanted).withColumns(bounds)), []
        while not open_.isEmpty():
            parts = open_.withColumn("l", F.explode(_halves("l0", "l1"))).withColumn("r", F.explode(_halves("r0", "r1")))
            parts = parts.withColumns({"l0": F.col("l.a"), "l1": F.col("l.b"), "r0": F.col("r.a"), "r1": F.col("r.b")}).drop("l", "r")
            parts = parts.where((F.col("l1") + F.col("r1") >= self.window) & (F.length("left") >= F.col("l0")) & (F.length("right") >= F.col("r0")))
            cut = {"near_left": "substring(left, 1, l0)", "near_right": "substring(right, 1, r0)", "far_left": "substring(left, 1, l1 + 1)", "far_right": "substring(right, 1, r1 + 1)"}
            parts = parts.withColumns({c: F.expr(e) for c, e in cut.items()})
            alike = materialise(parts.groupBy(*cell, "far_left", "far_right").agg(*places))
            sides = [F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in ("far_left", "far_right")]
            cells = alike.groupBy(*cell).agg(F.count(F.lit(1)).alias("variants"), *sides).where("variants > 1")
            for side, last in (("far_left", "l1"), ("far_right", "r1")):  # no repeat ends in a cell where all go on alike
                cells = cells.where((F.col(f"{side}.a") != F.col(f"{side}.b")) | (F.length(f"{side}.a") <= F.col(last)))
            fits = (F.col("variants") <= self.group_rows) | ((F.col("l0") == F.col("l1")) & (F.col("r0") == F.col("r1")))
            cells = materialise(cells.select(*cell, fits.alias("fits"), F.monotonically_increasing_id().alias("group")))
            small = cells.where("fits").drop("fits")
            suffixes = alike.join(small, cell).withColumnsRenamed({"far_left": "left", "far_right": "right"})
            found = self._compared(suffixes, [("group", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
            found = found.withColumnsRenamed({"left": "far_left", "right": "far_right"})
            out.append(materialise(parts.join(small, cell).join(found, ["group", "far_left", "far_right"]).select(*_KEY, "repeats")))
            rest = materialise(parts.join(cells.where("NOT fits").select(*cell), cell).select(*open_.columns))
            discard(open_, alike, cells)
            open_ = rest
        discard(open_)
        return out

    def spans(self) -> DataFrame:
        """``kid, segments``: the segments of each document (``at``, the content's places, ``repeats``) of which something repeats; see ``spans_of``.

        What is told of a content goes to all of its places. The join leaves them next to each other and nothing is gathered before the shuffle, so its
        compression finds the copies; lists gathered by document would part them. Documents are dealt to as many tasks as keep the pieces of a task few.
        """
        pieces = self.told.agg(F.sum(F.col("n") * (1 + F.coalesce(F.size("repeats.left"), F.lit(0))))).first()[0] or 0
        parts = -(-pieces // _TASK_PIECES)
        dealt = (parts, "kid") if parts > int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ("kid",)
        each = self.segments.select("kid", "at", *_KEY).join(self.told, _KEY).select("kid", "at", *_PLACES, "repeats").repartition(*dealt)
        return each.groupBy("kid").agg(F.collect_list(F.struct("at", *_PLACES, "repeats")).alias("segments"))


def spans_of(lists: pa.ListArray, window: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The document (no. of the list) and ``start, end, gone, open_left, open_right, n, low, high, bits, mixed`` of each piece of a repeat in lists of segments; those with ``gone`` are what is removed.

    Segments that stand twice are covered whole; one of its own as far as its repeats reach.
    """
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    segments = lists.flatten()
    at, *own = (segments.field(c).to_numpy() for c in ("at", *_PLACES))
    size = segments.field("repeats").value_lengths().fill_null(0).to_numpy()
    repeats = segments.field("repeats").flatten()
    left, right, *places = (repeats.field(c).to_numpy() for c in ("left", "right", *_PLACES))
    opened = [np.concatenate((np.ones(len(at), bool), x & _OPEN > 0)) for x in (left, right)]
    left, right = left & ~_OPEN, right & ~_OPEN
    start, windows = at >> 20, (at >> 10) & 1023
    anchor, end, alone = start + (at & 1023), start + windows - 1 + window, own[0] == 1
    if len(left):
        first = np.minimum(np.cumsum(size) - size, len(left) - 1)
        furthest = [np.maximum.reduceat(x, first[size > 0]) for x in (left, right)]
        for out, far, sign in ((start, furthest[0], -1), (end, furthest[1], 1)):
            reached = anchor.copy()
            reached[size > 0] += sign * far
            out[alone] = reached[alone]
    of = np.repeat(np.arange(len(at)), size)
    spans = {"start": np.concatenate((start, anchor[of] - left)), "end": np.concatenate((end, anchor[of] + right)), "gone": np.arange(len(at) + len(of)) < len(at), "open_left": opened[0], "open_right": opened[1]}
    spans |= {c: np.concatenate(x) for c, *x in zip(_PLACES, own, places, strict=True)}
    return np.concatenate((doc, doc[of])), spans


#: What ``_cut`` found in texts with many repeats, by the search and their hashes, for copies that the same worker meets.
_KNOWN: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()
_KNOWN_ROWS, _MANY = 1 << 18, 1 << 9  # repeats held in all, 32 bytes each, and of a text that is worth holding


def _few_spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about _SPANS pieces of repeats each (one row at least)."""
    lists = batch.column("segments")
    size = lists.flatten().field("repeats").value_lengths().fill_null(0).to_numpy() + 1
    reached = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + _SPANS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _cut(raw: list[bytes], segments: pa.ListArray, window: int, search: bytes) -> tuple[list[int], pa.ListArray, list[bytes], pa.ListArray]:
    """For each text: how many bytes go, the runs that go, the other bytes, and its repeats. Equal texts have equal segments, so each is looked into once in a ``search``."""
    names = [search + xxhash.xxh3_128_digest(r) for r in raw]
    found = {name: _KNOWN[name] for name in names if name in _KNOWN}
    new = list({name: i for i, name in enumerate(names) if name not in found}.values())
    doc, spans = spans_of(segments.take(pa.array(new, pa.int64())), window)
    gone, repeats = np.stack(removed_runs(doc, spans), axis=1), whole_repeats(doc, spans, window) if len(doc) else np.zeros((0, 4), np.int64)
    bounds = [np.searchsorted(x[:, 0], np.arange(len(new) + 1)) for x in (gone, repeats)]
    for k, i in enumerate(new):
        mine, text = repeats[bounds[1][k] : bounds[1][k + 1]].copy(), memoryview(raw[i])
        mine[:, 0] = [xxhash.xxh3_64_intdigest(text[a:b]) - (1 << 63) for a, b in zip(mine[:, 1].tolist(), mine[:, 2].tolist(), strict=True)]
        found[names[i]] = gone[bounds[0][k] : bounds[0][k + 1], 1:], mine
        if _MANY <= len(mine) <= _KNOWN_ROWS // 4:
            _KNOWN[names[i]] = found[names[i]][0].copy(), mine
    for name in names:
        if name in _KNOWN:
            _KNOWN.move_to_end(name)
    held = sum(len(x) for _, x in _KNOWN.values())
    while held > _KNOWN_ROWS:
        held -= len(_KNOWN.popitem(last=False)[1][1])
    each = [found[name] for name in names]
    kept = []
    for text, (runs, _) in zip(raw, each, strict=True):
        cuts = [0, *runs.ravel().tolist(), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if len(runs) else text)
    lists = [_lists([x[k] for x in each], kind) for k, kind in enumerate((_RUN, _FOUND))]
    return [len(a) - len(b) for a, b in zip(raw, kept, strict=True)], lists[0], kept, lists[1]


_RUN, _FOUND = ("start", "end"), ("repeat", "start", "end", "places")


def _lists(rows: list[np.ndarray], names: tuple[str, ...]) -> pa.ListArray:
    """A list of structs for each array of rows."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    columns = np.concatenate([*rows, np.zeros((0, len(names)), np.int64)]).T
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=list(names)))


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 32, group_rows: int = 100_000) -> DataFrame:
    """``id_col, repeat, start, end, places``: each maximal repeat of ``window`` bytes or more with all places where it stands, one row for each.

    Rows of one ``repeat`` hold the same bytes; ``places`` is how many there are, ``start`` and ``end`` count bytes. See ``suffix_dedup``.
    A repeat whose parts stand in more places than itself is put together from them by the documents' keys (``whole_repeats``). That is
    exact for passages of prose; of texts that overlap with themselves (two random letters, say) about a quarter of the groups is missed.
    """
    found = suffix_dedup(df, id_col, text_col, window, gram, group_rows)
    each = materialise(found.select(id_col, F.explode("repeats").alias("r")).select(id_col, "r.repeat", "r.start", "r.end"))
    return each.join(each.groupBy("repeat").agg(F.count(F.lit(1)).alias("places")).where("places > 1"), "repeat").select(id_col, "repeat", "start", "end", "places")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 32, group_rows: int = 100_000) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, removed, kept, repeats``.

    A byte of the UTF-8 text goes if a string of ``window`` bytes covers it that also starts anywhere else, in another row or at
    another place of the same one; strings are judged on the input and never cross rows. ``removed`` holds the maximal
    runs of bytes that go, ``kept`` (binary) the other bytes, ``repeats`` the maximal repeats that stand in the row (repeat, start, end, places).
    Null text counts as empty; texts under ``window`` bytes lose nothing.
    Rows repeated lose all, as each stands elsewhere too; ids may be null or repeat. An empty table gives an
    empty result; other columns are not read. ``window`` is at most 1000.

    An anchor with more than ``group_rows`` different surroundings (of ``2 * window - gram`` bytes at most) is not put into one task; its repeats are dealt
    by how far they reach from it (``_by_cells``), with the same results.
    """
    found, search = RepeatFinder(df, id_col, text_col, window, gram, group_rows), uuid.uuid4().bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            for part in _few_spans(batch):
                raw = [t.encode() for t in part.column("text").to_pylist()]
                lost, removed, kept, repeats = _cut(raw, part.column("segments"), window, search)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(lost, pa.int64()), pa.array(removed.value_lengths()).cast(pa.int64()), removed, pa.array(kept, pa.binary()), repeats],
                    names=[id_col, "n_bytes", "n_removed", "n_spans", "removed", "kept", "repeats"],
                )

    listed = "array<struct<repeat:bigint,start:bigint,end:bigint,places:bigint>>"
    cut = documents(found.rows).join(found.spans(), "kid", "left").select("id", "text", "segments")
    return cut.mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<start:bigint,end:bigint>>, kept binary, repeats {listed}")
