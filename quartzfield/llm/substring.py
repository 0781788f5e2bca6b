"""Substring dedup on words: a sparse de Bruijn graph whose nonbranching repeated paths are compacted by joins.

Edges are the k-mers of ``window`` words. Runs of edges with one anchor are one path (``segments``). Where all paths through an
anchor are equal, the node does not branch and the path stays compacted: its first document is that of each of its edges. Where
paths differ, the node branches and its paths are unfolded into single edges, which meet on their hash. The kept
source coordinates then give the words that each document loses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .segments import branching, cut_spans, first_window, keyed, repeated_segments, segment_texts, union_of, unpack, window_count, word_symbols

_KEY = ["c1", "c2"]


def repeated_spans(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``kid, start, end``: words covered by a window that also starts in a document with a smaller id."""
    segments = repeated_segments(rows, word_symbols, window, gram, with_doc=True)
    paths = segments.groupBy(*_KEY).agg(F.min("g").alias("g"), F.min("doc").alias("first"), F.min_by("kid", "doc").alias("kid"), F.min_by("at", "doc").alias("at"))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                symbols = word_symbols([text.encode()])
                where = [unpack(w["at"]) for w in wanted]
                count = np.array([n for _, n, _ in where])
                offset = np.concatenate([np.arange(n) for _, n, _ in where])
                start = np.repeat(np.array([s for s, _, _ in where]), count) + offset
                edges = symbols.digests(start, start + window)
                columns = [edges[:, 0], edges[:, 1], offset.astype(np.int32)]
                columns += [np.repeat(np.array([w[c] for w in wanted], np.int64), count) for c in (*_KEY, "first")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["e1", "e2", "offset", *_KEY, "first"])

    forks = branching(paths).select("kid", "at", "first", *_KEY)
    edges = segment_texts(rows, forks, unfold, "e1 bigint, e2 bigint, offset int, c1 bigint, c2 bigint, first bigint")
    # one shuffle of the edges; Spark spills the rows of an edge that very many paths share
    later = edges.withColumn("least", F.min("first").over(Window.partitionBy("e1", "e2"))).where("first > least").groupBy(*_KEY).agg(F.min("offset").alias("from"), F.max("offset").alias("to"))
    verdict = paths.select(*_KEY, "first").join(later, _KEY, "left")
    own = F.col("doc") == F.col("first")
    start = F.when(own, first_window() + F.col("from")).otherwise(first_window())
    end = F.when(own, first_window() + F.col("to") + window).otherwise(first_window() + window_count() - 1 + window)
    return segments.select("doc", "kid", "at", *_KEY).join(verdict, _KEY).where(~own | F.col("from").isNotNull()).select("kid", start.alias("start"), end.alias("end"))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 10) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_removed, removed, kept``.

    Words are runs of bytes other than ASCII white space. A word goes if some window of ``window`` words covers it whose
    words also start, in that order, in a document with a smaller id; windows are judged on the input. ``removed`` holds the
    spans of words that go, ``kept`` the other words joined by one space. Null text counts as empty; texts of fewer
    than ``window`` words lose nothing. A null id counts as larger than any other; rows that share an id lose nothing to each
    other. An empty table gives an empty result; other columns are not read. ``window`` is at most 1000.
    """
    rows = keyed(df, id_col, text_col)
    spans = repeated_spans(rows, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, lost, removed, kept = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                gone = union_of(found, len(words))
                total.append(len(words))
                lost.append(sum(b - a for a, b in gone))
                removed.append([{"start": a, "end": b} for a, b in gone])
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "removed", "kept"])

    return cut_spans(rows, spans, run, f"`{id_col}` bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept string")
