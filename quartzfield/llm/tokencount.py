"""Token counts by a two-tier look-up on the map side: a broadcast table of frequent pre-tokens, then a cache in each worker."""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices, text_of

#: Pre-tokens of a byte-level tokenizer's own rule (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of more characters are neither counted as frequent nor cached, which bounds the bytes of both tiers.
LONGEST = 32


class _Unsure(Exception):
    """A pre-token holds a character whose class depends on the Unicode version, so only the library can cut its text."""


class Library:
    """A tokenizer file as its own library reads it: ``tokenizers`` for ``.json``, ``sentencepiece`` for ``.model``.

    ``specials`` and ``find`` are there only where texts fall into pre-tokens that are encoded each by itself: byte-level files
    without normalisation whose special tokens take no white space along. Other files are counted on whole texts.
    """

    def __init__(self, path: str):
        self.find = None
        if path.endswith(".model"):
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count: Callable[[str], int] = lambda text: len(made.encode(text, num_threads=1))
            return
        import tokenizers

        tokenizer = tokenizers.Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre, added = rules.get("pre_tokenizer") or {}, rules.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not rules.get("normalizer")
        if plain and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            self.find = regex.compile(BYTE_LEVEL)
            longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
            self.specials = regex.compile("|".join(map(regex.escape, longest_first))) if added else None

    def segments(self, text: str) -> tuple[list[str], int]:
        """What stands between special strings, and how many of those there are: the library takes them for one token each."""
        if self.specials is None or not self.specials.search(text):
            return [text], 0
        parts = self.specials.split(text)
        return [p for p in parts if p], len(parts) - 1

    def pieces(self, segment: str) -> Iterable[str]:
        """Pre-tokens; a very long segment gives them one by one."""
        return self.find.findall(segment) if len(segment) < 1 << 20 else (m.group() for m in self.find.finditer(segment))


_LIBRARIES: dict[str, Library] = {}


def library_of(path: str) -> Library:
    """The library of this process for a file; loaded once, whatever the number of tasks."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


class Lengths(dict):
    """Tokens by pre-token. The frequent ones stay; others are encoded when they are missing and kept beside them until ``cache_size`` are, then they make room."""

    def __init__(self, library: Library, frequent: dict[str, int], cache_size: int = 1 << 18):
        super().__init__(frequent)
        self.library, self.frequent, self.most = library, frequent, len(frequent) + cache_size

    def __missing__(self, piece: str) -> int:
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            raise _Unsure
        n = self.library.count(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def of(self, text: str) -> int:
        """Tokens of a text, as the library gives them for the whole of it."""
        library = self.library
        if library.find is None:
            return library.count(text)
        segments, total = library.segments(text)
        try:
            for s in segments:
                total += sum(map(self.__getitem__, library.pieces(s)))
        except _Unsure:
            return library.count(text)
        return total


def _shrink(counts: Counter, size: int) -> Counter:
    """The ``size`` largest counts less the next one (Misra and Gries): a count is too low by a ``size``-th of all at most."""
    if len(counts) <= size:
        return counts
    top = counts.most_common(size + 1)
    less = top[-1][1]
    return Counter({k: n - less for k, n in top if n > less})


def _packed(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], names=["pieces", "counts"])


def frequent_pieces(df: DataFrame, path: str, text_col: str = "text", size: int = 1 << 15, fan_in: int = 32) -> list[str]:
    """The most frequent pre-tokens of all texts, ``size`` at most, the most frequent first.

    Every task keeps a Misra-Gries summary of what it reads; summaries are merged by neighbouring tasks, ``fan_in`` at a time, so no
    pre-token is ever shuffled and the driver gets one summary. A pre-token that makes up more than a ``size``-th of all is never
    missed. Which ones are found matters for speed only.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, counts = library_of(path), Counter()
        for batch in slices(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                for s in library.segments(text)[0]:
                    counts.update(library.pieces(s))
            if len(counts) > 4 * size:
                counts = _shrink(counts, size)
        usual = {k: n for k, n in counts.items() if len(k) <= LONGEST and (k.isascii() or not any(unicodedata.category(c) == "Cn" for c in k))}
        yield _packed(_shrink(Counter(usual), size))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                for k, n in zip(row["pieces"], row["counts"], strict=True):
                    counts[k] += n
            counts = _shrink(counts, size)
        yield _packed(counts)

    schema = "pieces array<string>, counts array<bigint>"
    parts = materialise(df.select(text_of(text_col).alias("text")).mapInArrow(summarise, schema))
    tasks = parts.rdd.getNumPartitions()
    while tasks > 1:  # counted here, as a stored summary may be larger than what Spark puts in a partition
        tasks = -(-tasks // fan_in)
        merged = materialise(parts.coalesce(tasks).mapInArrow(merge, schema))
        discard(parts)
        parts = merged
    counts: Counter = Counter()
    for row in parts.collect():  # the rows of one last partition
        for k, n in zip(row.pieces, row.counts, strict=True):
            counts[k] += n
    discard(parts)
    return [k for k, _ in _shrink(counts, size).most_common()]


def _pack(pieces: list[str], lengths: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The compact table that is broadcast: all bytes in a row, bytes and tokens of each pre-token; about 16 bytes an entry, 132 at most."""
    raw = [p.encode() for p in pieces]
    return b"".join(raw), np.array([len(r) for r in raw], np.uint8), np.array(lengths, np.uint16)


def _unpack(packed: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    raw, sizes, tokens = packed
    ends = np.cumsum(sizes, dtype=np.int64)
    return {raw[e - s : e].decode(): t for e, s, t in zip(ends.tolist(), sizes.tolist(), tokens.tolist(), strict=True)}


_READY: dict[str, Lengths] = {}


def _lengths(path: str, table, name: str) -> Lengths:
    """The two tiers of this process for a broadcast table of this name; those of an earlier table go."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Lengths(library_of(path), _unpack(table.value))
    return _READY[name]


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", size: int = 1 << 15) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_tokens, over_limit``, counted as the library of the file ``path`` counts.

    ``n_bytes`` is the text's length in UTF-8, ``over_limit`` says whether it has more than ``limit`` tokens. No begin, end or added
    tokens; special strings inside a text are what the library makes of them by default. Null text counts as empty and has no
    tokens; ids may be null or repeat, each row is counted by itself; an empty table gives an empty result; other columns are not read. Texts
    of any length are counted whole. The file must lie at ``path`` on every machine. No rows move between machines.
    """
    library = library_of(path)
    pieces = frequent_pieces(df, path, text_col, size) if library.find is not None else []
    table, name = df.sparkSession.sparkContext.broadcast(_pack(pieces, [library.count(p) for p in pieces])), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path, table, name)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            tokens = np.array([lengths.of(t) for t in texts.to_pylist()], np.int64)
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
