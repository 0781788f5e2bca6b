"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space; other differences count as edits."""
    return " ".join(text.lower().split())


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """Cut an item into ``budget + 1`` pieces of like length; within ``budget`` edits one of them stays intact."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _columns(pattern: str) -> tuple[dict[str, int], int, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits, (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)


def best_match(pattern: str, text: str, budget: int, start: int = 0, within: int | None = None) -> tuple[int, int] | None:
    """(distance, end) of the first place from ``start`` on where ``pattern`` ends with the fewest edits, None above ``budget``.

    With ``within`` the search ends so many characters behind the first place within the budget, so that what comes later counts for itself. As many edits as
    the pattern is long, which any place allows, are no match. Myers' bit-parallel recurrence: the vertical differences of one column are two bit vectors.
    """
    bits, mask, top = _columns(pattern)
    plus, minus, score, best = mask, 0, len(pattern), None
    get, least, last = bits.get, budget + 1, len(text)
    for j in range(start, last):
        if j >= last:
            break
        c = text[j]
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (mask & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < least:
                if best is None and within is not None:
                    last = min(last, j + 1 + within)
                least, best = score, (score, j + 1)
                if not score:
                    break
        up = up << 1 & mask
        plus = (down << 1 & mask) | (mask & ~(xv | up))
        minus = up & xv
    return best


class Matcher:
    """Searches texts for a block of items. Items of fewer than ``min_chars`` characters are found as they are, between other characters than letters and digits."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int = 0):
        self.items, self.error_rate = [], error_rate
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            short = len(text) < min_chars
            budget = 0 if short else int(len(text) * error_rate)
            for offset, piece in pieces_of(text, budget):
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, budget, text[::-1], short))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, start, end, distance) in the normalised text: every place of an item that does not overlap with the one before."""
        if not self.items:
            return
        starts: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for item, offset in places:
                starts.setdefault(item, set()).add(last + 1 - size - offset)
        for item in sorted(starts):
            item_id, pattern, budget, _, short = self.items[item]
            if short:
                for at in sorted(starts[item]):
                    end = at + len(pattern)
                    if not text[at - 1 : at].isalnum() and not text[end : end + 1].isalnum():
                        yield item_id, at, end, 0
                continue
            low = high = None
            for at in [*sorted(starts[item]), None]:
                if at is not None and low is not None and at - budget <= high:
                    high = max(high, at + len(pattern) + budget)
                    continue
                if low is not None:
                    yield from self._places(item, text, max(0, low), high)
                if at is not None:
                    low, high = at - budget, at + len(pattern) + budget

    def _places(self, item: int, text: str, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        item_id, pattern, budget, reverse, _ = self.items[item]
        window, at = text[low:high], 0
        while hit := best_match(pattern, window, budget, at, 2 * budget):
            distance, end = hit
            back = best_match(reverse, window[max(at, end - len(pattern) - budget) : end][::-1], distance)
            yield item_id, low + end - (back[1] if back else end - at), low + end, distance
            at = end


def _item_blocks(bench: DataFrame, id_col: str, text_col: str, least: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, taken one partition at a time."""
    block, size = [], 0
    rows = bench.select(F.col(id_col).cast("bigint").alias("i"), text_of(text_col).alias("t")).where("i is not null").distinct()
    for row in rows.toLocalIterator():
        text = normalise(row.t)
        if len(text) < least:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.i, text))
        size += len(text)
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = 0.08,
    min_chars: int = 24,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """Places where a benchmark item stands in a document: ``id_col, item_id, start, end, distance, item_chars, passage``.

    Both sides are lower-cased with white space folded; an item matches where the edit distance is at most
    ``int(item_chars * error_rate)``. ``start`` and ``end`` count code points of the normalised text, ``passage`` is that part of it.
    Every place gives a row; places of one item do not overlap, of those that would the one with the fewest edits counts (ties: the first).
    Items of fewer than ``min_chars`` normalised characters match without edits only, between other characters than letters and digits; empty items match nothing. Null texts count as
    empty and match nothing; rows with a null document id are searched and give a null id; rows repeated give their matches again;
    items with a null id are ignored and repeated items count once; empty tables give an empty result.

    The items go to the executors in blocks of ``block_chars`` characters at most, one pass over the documents for each block,
    so what is sent at once has a fixed bound; all of the benchmark passes through the driver, block by block. Documents are searched whole and don't move.
    """
    schema = f"`{id_col}` bigint, `{item_id}` bigint, start bigint, end bigint, distance int, item_chars int, passage string"
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def searcher(block: list[tuple[int, str]]):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate, min_chars)
            size = {i: len(t) for i, t in shared.value}
            for batch in slices(batches, "text"):
                out = []
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    plain = normalise(text)
                    out += [(doc, item, a, b, d, size[item], plain[a:b]) for item, a, b, d in matcher.search(plain)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.string()], strict=True)], names=[id_col, item_id, "start", "end", "distance", "item_chars", "passage"])

        return run

    parts = [source.mapInArrow(searcher(block), schema) for block in _item_blocks(bench, item_id, item_text, 1, block_chars)]
    if not parts:
        return source.where("false").mapInArrow(searcher([]), schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.08, min_chars: int = 24, block_chars: int = 4_000_000) -> DataFrame:
    """The rows in whose text no benchmark item of ``min_chars`` characters or more stands, with all their columns as they are. Shorter items tell no leak. No rows move."""

    def without(block: list[tuple[int, str]]):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for batch in slices(batches, text_col):
                clean = [next(matcher.search(normalise(t or "")), None) is None for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    out = docs
    for block in _item_blocks(bench, item_id, item_text, min_chars, block_chars):
        out = out.mapInArrow(without(block), docs.schema)
    return out
