"""Repeated windows without a row for each window: runs of windows that share their minimizer become one segment.

A window is ``window`` consecutive symbols (bytes or words) of one document. Its anchor is the leftmost of its ``gram``-symbol
substrings with the lowest hash, so equal windows have equal anchors wherever they stand. Consecutive windows with one anchor form
a segment, about 2 / (window - gram) of them for each symbol. Segments are equal where the 128-bit hashes of their whole content are
(xxh3 over the bytes; a word counts as the 128-bit hash of its bytes); only segments that share their anchor with a different one are looked into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_of

_CHUNK = 1 << 17  # symbols that are scanned at once
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=_U)
_BASE = int(_rng.integers(1 << 32, 1 << 63, dtype=_U)) | 1
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse, one table for all pieces."""
    if not _POWERS:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(2 * _CHUNK + 1, _U(b))
            out[0] = _U(1)
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of ``k`` symbols of a piece. They choose anchors only: equal runs have equal hashes, nothing else is asked of them."""
    power, inverse = _powers()
    sums = np.zeros(len(symbols) + 1, _U)
    np.cumsum(symbols * power[: len(symbols)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: len(sums) - k])


class Symbols:
    """The symbols of some texts: a number for each (to choose anchors), their bytes (to compare), and where each text starts (and the last one ends)."""

    def __init__(self, numbers: np.ndarray, data: bytes, unit: int, bounds: np.ndarray):
        self.numbers, self.data, self.unit, self.bounds = numbers, data, unit, bounds

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128-bit hashes (two columns) of runs of symbols, over the bytes of the run itself."""
        view, digest = memoryview(self.data), xxhash.xxh3_128_digest
        places = zip((start * self.unit).tolist(), (end * self.unit).tolist(), strict=True)
        return np.frombuffer(b"".join([digest(view[a:b]) for a, b in places]), np.int64).reshape(-1, 2)


def _bounds(sizes: list[int]) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(np.array(sizes, np.int64), dtype=np.int64)))


def byte_symbols(texts: list[bytes]) -> Symbols:
    """The bytes of texts."""
    data = b"".join(texts)
    return Symbols(_BYTES[np.frombuffer(data, np.uint8)], data, 1, _bounds([len(t) for t in texts]))


class WordHashes(dict):
    """128-bit hashes of words, each from all of its bytes. Those of short words are remembered, up to a bound."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> bytes:
        found = xxhash.xxh3_128_digest(word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = found
        return found

    def of(self, text: bytes) -> bytes:
        """16 bytes for each word (run of bytes other than ASCII white space)."""
        return b"".join(map(self.__getitem__, text.split()))


_WORDS = WordHashes()


def word_symbols(texts: list[bytes]) -> Symbols:
    """The words of texts, as 128-bit hashes."""
    parts = [_WORDS.of(t) for t in texts]
    data = b"".join(parts)
    return Symbols(np.frombuffer(data, _U)[::2], data, 16, _bounds([len(p) // 16 for p in parts]))


def segments_of(symbols: Symbols, window: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """Segments of texts: text no., first window's start in it, number of windows, anchor's offset from that start, anchor, content hash.

    About _CHUNK symbols are scanned at once. A longer text is scanned in parts; the last segment of a part, which may go on, begins the next one.
    """
    group, size = [], 0
    for i, (a, b) in enumerate(zip(symbols.bounds[:-1].tolist(), symbols.bounds[1:].tolist(), strict=True)):
        while b - a > _CHUNK:
            found = _scan(symbols, [(i, a, a + _CHUNK)], window, gram)
            a = int(found["start"][-1] + symbols.bounds[i])
            yield {k: v[:-1] for k, v in found.items()}
        if b - a >= window:
            group.append((i, a, b))
            size += b - a
            if size >= _CHUNK:
                yield _scan(symbols, group, window, gram)
                group, size = [], 0
    if group:
        yield _scan(symbols, group, window, gram)


def _scan(symbols: Symbols, group: list[tuple[int, int, int]], window: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of parts (text, from, to) of texts, fewer than 2 * _CHUNK symbols in all."""
    part = np.concatenate([symbols.numbers[a:b] for _, a, b in group])
    offset = _bounds([b - a for _, a, b in group])
    grams = gram_hashes(part, gram)
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
    span, width = 1, window - gram + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: span - width], low[width - span :])
    starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(offset[:-1], offset[1:], strict=True)])
    anchor = (low[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
    anchor = anchor[new]
    piece = np.searchsorted(offset, first, side="right") - 1
    text = np.array([i for i, _, _ in group])[piece]
    shift = np.array([a for _, a, _ in group])[piece] - offset[piece]
    content = symbols.digests(first + shift, last + window + shift)
    return {"text": text, "start": first + shift - symbols.bounds[text], "windows": last - first + 1, "anchor": anchor - first, "g": grams[anchor].view(np.int64), "c1": content[:, 0], "c2": content[:, 1]}


#: How a segment lies in its document: start << 20 | windows << 10 | offset of the anchor.
def pack(start: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (start << 20) | (windows << 10) | anchor


def unpack(at: int) -> tuple[int, int, int]:
    return at >> 20, (at >> 10) & 1023, at & 1023


def first_window():
    """Column: start of the segment's first window."""
    return F.shiftright("at", 20)


def window_count():
    """Column: number of the segment's windows."""
    return F.shiftright("at", 10).bitwiseAND(1023)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, doc, kid, text``: the id, the same with null as the largest number, a 64-bit key of id (none differs from any number) and text, and the text (null: empty)."""
    text = text_of(text_col)
    doc = F.col(id_col).cast("bigint")
    return df.select(doc.alias("id"), F.coalesce(doc, F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.coalesce(doc, F.lit(-1)), doc.isNull(), text).alias("kid"), text.alias("text"))


def repeated_segments(rows: DataFrame, symbols: Callable, window: int, gram: int, with_doc: bool = False) -> DataFrame:
    """Segments whose anchor stands elsewhere too: ``g, c1, c2, kid, at`` (and ``doc``), written to the shared folder.

    ``g`` is the anchor, (``c1``, ``c2``) the content. Anchors are counted before the shuffle; the join back is one that AQE can
    split when an anchor is very frequent.
    """
    names = ["g", "c1", "c2", "kid", "at"] + ["doc"] * with_doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            doc, kid = (batch.column(c).to_numpy() for c in ("doc", "kid"))
            for s in segments_of(symbols(texts), window, gram):
                arrays = [s["g"], s["c1"], s["c2"], kid[s["text"]], pack(s["start"], s["windows"], s["anchor"]), doc[s["text"]]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays[: len(names)]], names=names)

    found = rows.select("doc", "kid", "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    anchors = found.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("g")
    return materialise(found.join(anchors, "g"))


def branching(unique: DataFrame) -> DataFrame:
    """Distinct segments whose anchor is also that of a different segment, with the number of those ``variants``."""
    return unique.join(unique.groupBy("g").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1"), "g")


def segment_texts(rows: DataFrame, wanted: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Run ``run`` over (text, array of wanted segments) of each document that has some."""
    fields = [c for c in wanted.columns if c != "kid"]
    lists = wanted.groupBy("kid").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    return documents(rows).join(lists, "kid").select("text", "wanted").mapInArrow(run, schema)


def documents(rows: DataFrame) -> DataFrame:
    """The side of both joins with the texts, alike in both so that Spark shuffles the texts once."""
    return rows.select("id", "kid", "text")


def cut_spans(rows: DataFrame, spans: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Run ``run`` over (id, text, spans) of each document, with or without spans (``kid, start, end`` and others)."""
    lists = spans.groupBy("kid").agg(F.collect_set(F.struct(*[c for c in spans.columns if c != "kid"])).alias("spans"))
    return documents(rows).join(lists, "kid", "left").select("id", "text", "spans").mapInArrow(run, schema)


def union_of(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover, cut at the ends of the document."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, s["start"]), min(size, s["end"])) for s in spans or ()):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
