"""Secret scans: patterns give the base findings, a character CNN in numpy rates every other candidate in its surroundings."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_of

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_EDGE = ".=-_/"  # not part of a candidate at its ends, unless as padding
KINDS = ("assign", "access", "hex", "cnn")

#: Code points around a candidate, and those of the candidate that one window holds; longer candidates get several windows.
BEFORE, INSIDE, AFTER = 16, 48, 8
_WIDTH = BEFORE + INSIDE + AFTER

#: Lower edges of the probability bins in which scores are counted, 16 to a unit of the logit.
EDGES = np.concatenate([[0.0], 1 / (1 + np.exp(-np.arange(-480, 480) / 16))])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind no., end) of the pattern findings, leftmost and non-overlapping within each kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of 12 or more characters of the secret alphabet, without punctuation at their ends."""
    for m in _RUN.finditer(text):
        run = m[0].rstrip(".-_/")
        start = m.start() + len(run) - len(run.lstrip(_EDGE))
        end = m.start() + len(run)
        if end - start >= 12:
            yield start, end


def windows_of(text: str, start: int, end: int) -> list[str]:
    """Fixed-width windows that together hold the whole candidate, each with what stands before and after the candidate."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    return [before + text[a : min(end, a + INSIDE)].ljust(INSIDE, "\0") + after for a in range(start, end, INSIDE)]


def encode(windows: list[str]) -> np.ndarray:
    """Character numbers: 0 padding, ASCII as it is, 128 any other."""
    codes = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), _WIDTH)
    return np.minimum(codes, 128).astype(np.int64)


@dataclass
class CharCnn:
    """Embedding, one convolution, maxima over the candidate and over its surroundings, logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    measured: tuple[int, int] = (0, 0)  # positives that reach the threshold, of how many that it was set on

    SPAN = 5

    @classmethod
    def new(cls, dims: int = 8, filters: int = 24, seed: int = 5) -> CharCnn:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (129, dims)), r.normal(0, (2 / (dims * cls.SPAN)) ** 0.5, (dims * cls.SPAN, filters)), np.zeros(filters), r.normal(0, 0.1, 2 * filters), 0.0)

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, self.SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.SPAN * e.shape[2])
        act = np.maximum(cols @ self.kernel + self.bias, 0)
        inner = act[:, BEFORE : BEFORE + INSIDE]
        outer = np.concatenate([act[:, :BEFORE], act[:, BEFORE + INSIDE :]], axis=1)
        pooled = np.concatenate([inner.max(1), outer.max(1)], axis=1)
        return cols, act, inner, outer, pooled, pooled @ self.out + self.base

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[k : k + 512])[-1] for k in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 5e-3, batch: int = 64, seed: int = 7) -> None:
        """Adam on the log loss; classes weigh alike."""
        r = np.random.default_rng(seed)
        weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        names = ("embed", "kernel", "bias", "out")
        state = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in names}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(y), batch):
                some = order[k : k + batch]
                step += 1
                grads, base = self._gradient(x[some], y[some], weight[some])
                self.base -= rate * base
                for n in names:
                    m, v = state[n]
                    m += 0.1 * (grads[n] - m)
                    v += 0.001 * (grads[n] ** 2 - v)
                    setattr(self, n, getattr(self, n) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        cols, act, inner, outer, pooled, logit = self._forward(x)
        d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        filters = act.shape[2]
        back = d[:, None] * self.out
        grad = np.zeros_like(act)
        row, col = np.arange(len(x))[:, None], np.arange(filters)[None]
        at = inner.argmax(1) + BEFORE
        grad[row, at, col] += back[:, :filters]
        far = outer.argmax(1)
        grad[row, np.where(far < BEFORE, far, far + INSIDE), col] += back[:, filters:]
        grad *= act > 0
        kernel = np.einsum("npc,npf->cf", cols, grad)
        dims = self.embed.shape[1]
        dcols = (grad @ self.kernel.T).reshape(len(x), -1, self.SPAN, dims)
        embed = np.zeros_like(self.embed)
        for s in range(self.SPAN):
            np.add.at(embed, x[:, s : s + dcols.shape[1]], dcols[:, :, s])
        return {"embed": embed, "kernel": kernel, "bias": grad.sum((0, 1)), "out": pooled.T @ d}, float(d.sum())

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on examples that did not train the network."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - y) * z).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
            h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
            move = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = a - move[0], b - move[1]
            if abs(move).sum() < 1e-9:
                break
        self.scale, self.shift = float(max(a, 1e-3)), float(b)

    def keep_recall(self, counts: dict[int, int], recall: float) -> None:
        """Set the threshold to the highest edge of ``EDGES`` that the share ``recall`` of the counted positives reaches."""
        total = above = sum(counts.values())
        for k in sorted(counts):
            self.threshold, self.measured = float(EDGES[k]), (above, total)
            above -= counts[k]
            if above < recall * total:
                break


class Covered:
    """Tells how candidates lie to some spans, each in the time of one search."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in spans]
        self.furthest = list(accumulate((e for _, _, e in spans), max))
        self.nearest = list(accumulate((e for _, _, e in reversed(spans)), min))[::-1]

    def whole(self, a: int, b: int) -> bool:
        """One span holds all of it."""
        i = bisect_right(self.starts, a)
        return i > 0 and self.furthest[i - 1] >= b

    def label(self, a: int, b: int) -> int:
        """1 if the candidate stands in a span or holds one."""
        i = bisect_left(self.starts, a)
        return int(self.whole(a, b) or i < len(self.starts) and self.nearest[i] <= b)


def _bucket(text: str, start: int, end: int) -> int:
    """One of 8 by the hash of the candidate: 0 and 1 never train or calibrate, 2 and 3 calibrate, the others train."""
    return xxhash.xxh3_64_intdigest(text[start:end].encode("utf-8", "surrogatepass")) & 7


def labelled_candidates(df: DataFrame, text_col: str, max_examples: int) -> DataFrame:
    """``example, label, bucket``: ``max_examples`` windows of each label at most, those of the smallest hashes, none of buckets 0 and 1.

    Each task keeps its own smallest hashes, which hold all of the smallest of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[bytes, tuple[int, int]]] = [{}, {}]

        def cut(label: int) -> None:
            kept[label] = dict(sorted(kept[label].items(), key=lambda e: (e[1][0], e[0]))[:max_examples])

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                known = Covered(base_spans(text))
                for a, b in candidates(text):
                    bucket = _bucket(text, a, b)
                    if bucket < 2:
                        continue
                    label = known.label(a, b)
                    for w in windows_of(text, a, b):
                        example = w.encode("utf-8", "surrogatepass")
                        seen = (xxhash.xxh3_64_intdigest(example) - (1 << 63), bucket)
                        kept[label][example] = min(seen, kept[label].get(example, seen))
                    if len(kept[label]) > 4 * max_examples:
                        cut(label)
        for label in (0, 1):
            cut(label)
            columns = [list(kept[label]), [h for h, _ in kept[label].values()], [label] * len(kept[label]), [k for _, k in kept[label].values()]]
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["example", "hash", "label", "bucket"])

    seen = materialise(df.select(text_of(text_col).alias("text")).mapInArrow(run, "example binary, hash bigint, label int, bucket int"))
    once = seen.groupBy("example", "hash", "label").agg(F.min("bucket").alias("bucket"))
    picks = [once.where(F.col("label") == label).orderBy("hash", "example").limit(max_examples) for label in (0, 1)]
    return picks[0].unionByName(picks[1]).select("example", "label", "bucket")


def positive_scores(df: DataFrame, net: CharCnn, used: set[bytes], text_col: str = "text") -> dict[int, int]:
    """How many candidates of label 1 have their probability in each bin of ``EDGES``, over the whole table but those with a window in ``used``."""
    shared = df.sparkSession.sparkContext.broadcast((net, used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fitted = shared.value
        counts = np.zeros(len(EDGES), np.int64)
        for batch in slices(batches, "text"):
            windows, first = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                known = Covered(spans)
                for a, b in candidates(text) if spans else ():
                    if known.label(a, b):
                        own = windows_of(text, a, b)
                        if not any(w.encode("utf-8", "surrogatepass") in fitted for w in own):
                            first.append(len(windows))
                            windows += own
            if windows:
                p = np.maximum.reduceat(model.probability(encode(windows)), first)
                np.add.at(counts, np.searchsorted(EDGES, p, "right") - 1, 1)
        bins = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), pa.array(counts[bins])], names=["bin", "n"])

    rated = df.select(text_of(text_col).alias("text")).mapInArrow(run, "bin int, n bigint")
    return {r.bin: r.n for r in rated.groupBy("bin").agg(F.sum("n").alias("n")).collect()}


def fit_secrets(df: DataFrame, text_col: str = "text", max_examples: int = 3000, recall: float = 0.99) -> CharCnn | None:
    """Train on labelled findings: ``max_examples`` windows inside base findings and as many outside them at most.

    By the hash of the candidate a third of these examples calibrate the network, the others train it. The threshold is the one that
    keeps ``recall`` of all occurrences of candidates in base findings that neither trained nor calibrated it (a quarter of the candidates
    never does), whatever it comes to; if there are none, that of the calibrating ones. None if one of the labels has fewer than 6
    examples, or none to train or to calibrate.
    """
    rows = sorted((bytes(r.example), r.label, r.bucket) for r in labelled_candidates(df, text_col, max_examples).collect())
    y = np.array([label for _, label, _ in rows], float)
    fits = np.array([bucket > 3 for *_, bucket in rows], bool)
    if min((y > 0).sum(), (y == 0).sum()) < 6 or min((y[some] == v).sum() for some in (fits, ~fits) for v in (0, 1)) == 0:
        return None
    x = encode([e.decode("utf-8", "surrogatepass") for e, *_ in rows])
    net = CharCnn.new()
    net.fit(x[fits], y[fits])
    net.calibrate(x[~fits], y[~fits])
    counts = positive_scores(df, net, {e for e, *_ in rows}, text_col)
    if not counts:
        at = np.searchsorted(EDGES, net.probability(x[~fits & (y > 0)]), "right") - 1
        counts = dict(zip(*(c.tolist() for c in np.unique(at, return_counts=True)), strict=True))
    net.keep_recall(counts, recall)
    return net


def scan_secrets(df: DataFrame, net: CharCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, findings``, an array of (kind, start, end, probability) by start, then kind.

    Every candidate is rated. The pattern kinds ``assign``, ``access`` and ``hex`` are found whatever the network says of the candidates inside them, which is their
    probability (1 if there are none); ``cnn`` are candidates whose probability reaches the network's threshold and that no pattern finding covers whole. Places are code points, ends exclusive. Null text counts as
    empty and has no findings; ids may be null or repeat; an empty table gives an empty result; a text of any length is read whole.
    Without a network only patterns are used. No rows move.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", 2 << 20):
            base, where, windows = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                base.append(base_spans(text))
                for a, b in candidates(text) if model is not None else ():
                    for w in windows_of(text, a, b):
                        where.append((i, a, b))
                        windows.append(w)
            rated: list[dict[tuple[int, int], float]] = [{} for _ in base]
            for (i, a, b), p in zip(where, model.probability(encode(windows)).tolist() if windows else [], strict=True):
                rated[i][a, b] = max(p, rated[i].get((a, b), 0.0))
            out = []
            for spans, own in zip(base, rated, strict=True):
                known = Covered(spans)
                found = [(a, 3, b, p) for (a, b), p in own.items() if p >= model.threshold and not known.whole(a, b)]
                places = sorted(own)
                for a, k, b in spans:  # what the network says of candidates inside
                    inside = [own[c] for c in places[bisect_left(places, (a, a)) : bisect_left(places, (b, b))] if c[1] <= b]
                    found.append((a, k, b, max(inside, default=1.0)))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "probability": p} for a, k, b, p in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], names=[id_col, "findings"])

    source = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` bigint, findings array<struct<kind:string,start:bigint,end:bigint,probability:double>>")
