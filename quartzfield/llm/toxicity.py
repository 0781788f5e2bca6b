"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_of

#: Runs of letters and digits; compared in lower case.
TOKEN = re.compile(r"[^\W_]+")
_KINDS = "array<struct<start:bigint,end:bigint,score:double,e_value:double>>"


def parts_of(token: str) -> list[str]:
    """A lower-case token, and what stands for inflected forms of it: its first and last 4, 5 and 6 letters, if it is longer."""
    n = len(token)
    return [token, *(f"{token[:k]}-" for k in (4, 5, 6) if n > k), *(f"-{token[-k:]}" for k in (4, 5, 6) if n > k)]


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of word parts (nats, z), Karlin-Altschul parameters of clean text, and the logistic calibration of the evidence."""

    scores: dict[str, tuple[float, float]] = field(default_factory=dict)
    neutral: float = -0.3
    lam: float = 1.0
    k: float = 0.1
    intercept: float = 0.0
    slope: float = 0.0
    max_e: float = 0.05

    def e_value(self, score: float, tokens: int) -> float:
        """Segments of at least this score that clean text of so many tokens has on average."""
        return self.k * max(tokens, 1) * math.exp(-self.lam * score)

    def probability(self, evidence: float) -> float:
        x = self.intercept + self.slope * evidence
        return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(x))


class _Scores(dict):
    """Scores by token as written: that of its most significant part. What was looked up stays, up to a bound."""

    def __init__(self, model: ToxicityModel, bound: int = 200_000):
        super().__init__()
        self.model, self.bound = model, bound

    def __missing__(self, token: str) -> float:
        if len(self) >= self.bound:
            self.clear()
        known = [self.model.scores[x] for x in parts_of(token.lower()) if x in self.model.scores]
        self[token] = score = max(known, key=lambda x: x[1])[0] if known else self.model.neutral
        return score

    def of(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, tokens), np.float64, len(tokens))


def best_score(scores: np.ndarray) -> float:
    """Score of the best segment: the largest rise of the running sum; 0 if there is none."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    return float((total - np.minimum.accumulate(total)).max())


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum) in linear time, left to right (Ruzzo and Tompa 1999)."""
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((first, i + 1, low, total))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def evidence_of(segments: list[tuple[int, int, float]], tokens: int, model: ToxicityModel) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Log of (1 / E) summed over the significant segments, or that of the best one; and the significant segments."""
    if not segments:
        return -math.log(max(model.e_value(0.0, tokens), 1e-300)), []
    rated = [(a, b, s, model.e_value(s, tokens)) for a, b, s in segments]
    best = max(-math.log(max(e, 1e-300)) for *_, e in rated)
    good = [r for r in rated if r[3] <= model.max_e]
    return max(best, sum(-math.log(max(r[3], 1e-300)) for r in good)), good


def _scan(texts: list[str], model: ToxicityModel, cache: _Scores) -> Iterator[tuple[float, str, list]]:
    """Evidence, text and significant segments; the segments are only listed where the best one is significant."""
    for text in texts:
        scores = cache.of(text)
        best = best_score(scores)
        e = model.e_value(best, len(scores))
        if best <= 0 or e > model.max_e:
            yield -math.log(max(e, 1e-300)), text, []
        else:
            evidence, good = evidence_of(maximal_segments(scores.tolist()), len(scores), model)
            yield evidence, text, good


def _places(text: str, segments: list) -> list[dict]:
    if not segments:
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "e_value": e} for a, b, s, e in segments]


def training_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, max_labelled: int) -> DataFrame:
    """``_id, _label, _fold`` of labelled ids outside the held-out fold, about ``max_labelled`` of them at most, chosen by a hash of the id."""
    known = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    known = known.withColumn("_fold", F.crc32(F.col("_id").cast("string")) % folds).where("_fold <> 0")
    share = min(1.0, max_labelled / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return chosen.groupBy("_id", "_fold").agg(F.max("_label").alias("_label"))


def _parts(token: Column) -> Column:
    """As ``parts_of``."""
    n = F.length(token)
    some = [F.when(n > k, F.concat(F.left(token, F.lit(k)), F.lit("-"))) for k in (4, 5, 6)] + [F.when(n > k, F.concat(F.lit("-"), F.right(token, F.lit(k)))) for k in (4, 5, 6)]
    return F.array_compact(F.array(token, *some))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    max_labelled: int = 100_000,
    prior: float = 0.5,
    confidence: float = 1.96,
    neutral: float = -0.3,
) -> ToxicityModel:
    """Learn token log-odds and their calibration from labelled documents.

    Only rows with crc32(id as text) mod ``folds`` other than 0 are learnt from, about ``max_labelled`` of them at most, so they can be
    broadcast and the model is bounded. The last fold calibrates, the others give the log-odds, those of tokens and of their beginnings
    and ends (``parts_of``); a token counts once for each document, as repeats in one document are no new evidence. The log-odds between toxic
    and clean training text have a symmetric Dirichlet prior of ``prior`` for each part; a part scores the end of its confidence
    interval nearer to 0, if that leaves anything, and a token as its most significant part. All tokens carry the
    drift ``neutral``, so that clean text scores negatively, as extreme-value theory asks.

    On the clean documents of the calibrating fold, lambda solves sum p exp(lambda s) = 1 over their token scores, and K is the maximum-likelihood estimate from
    their best segments; the logistic calibration is fitted to the evidence of that fold. Without labels of both
    kinds the model has no tokens and gives each document the smoothed share of toxic labels.
    """
    sample = training_labels(labels, id_col, label_col, folds, max_labelled)
    text = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("text"))
    train = text.join(F.broadcast(sample), "_id").select("text", "_label", (F.col("_fold") == folds - 1).alias("_apart"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_pydict({"token": names, "toxic": [toxic[w] for w in names], "clean": [clean[w] for w in names]}, pa.schema([("token", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

        for batch in slices(batches, "text", 2 << 20):
            for t, label in zip(batch.column("text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                (toxic if label > 0 else clean).update(set(TOKEN.findall(t.lower())))
            if len(toxic) + len(clean) > 100_000:
                yield rows()
                toxic.clear()
                clean.clear()
        yield rows()

    tokens = train.where("NOT _apart").mapInArrow(count, "token string, toxic bigint, clean bigint").groupBy("token").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = materialise(tokens.select(F.explode(_parts(F.col("token"))).alias("token"), "t", "c").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    sums = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_toxic, n_clean, prior_all = float(sums[0]), float(sums[1]), prior * sums[2]
    share = sample.agg(F.sum(F.when(F.col("_label") > 0, 1).otherwise(0)), F.count(F.lit(1))).first()
    toxic_docs, all_docs = share[0] or 0, share[1]
    if not n_toxic or not n_clean:
        rate = (toxic_docs + 0.5) / (all_docs + 1)
        return ToxicityModel(neutral=neutral, intercept=math.log(rate / (1 - rate)) if all_docs else 0.0)

    yt, yc = F.col("t") + prior, F.col("c") + prior
    odds = F.ln(yt / (n_toxic + prior_all - yt)) - F.ln(yc / (n_clean + prior_all - yc))
    width = confidence * F.sqrt(1 / yt + 1 / yc)
    scored = counts.select("token", (F.signum(odds) * (F.abs(odds) - width) + neutral).alias("s"), (F.abs(odds) / width).alias("z")).where("z > 1")
    return _calibrated(train.where("_apart").select("text", "_label"), ToxicityModel({r.token: (r.s, r.z) for r in scored.collect()}, neutral))


def positive_root(mass: list[tuple[float, float]]) -> float:
    """The positive root of sum p exp(lambda s) = 1 over (p, s), at most 5; the larger the root, the rarer high scores in clean text."""

    def over(x: float) -> bool:
        return sum(p * math.exp(min(x * s, 700)) for p, s in mass) > 1

    low, high = 0.0, 5.0
    if not over(high):
        return high
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(high, 1e-3)


def _calibrated(apart: DataFrame, model: ToxicityModel) -> ToxicityModel:
    """Lambda, K and the logistic curve from documents that gave no log-odds; one pass over their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, clean = _Scores(model), Counter()
        names = ["label", "tokens", "scores"]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64())]
        for batch in slices(batches, "text", 2 << 20):
            label, tokens, segments = batch.column("_label").to_pylist(), [], []
            for text, y in zip(batch.column("text").to_pylist(), label, strict=True):
                scores = cache.of(text)
                tokens.append(len(scores))
                segments.append([s for *_, s in maximal_segments(scores.tolist())])
                if not y > 0:
                    clean.update(dict(zip(*(x.tolist() for x in np.unique(np.round(scores, 2), return_counts=True)), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((label, tokens, segments), kinds, strict=True)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([None] * len(clean), list(clean.values()), [[x] for x in clean]), kinds, strict=True)], names=names)

    seen = materialise(apart.mapInArrow(run, "label int, tokens bigint, scores array<double>"))
    bins = seen.where("label IS NULL").groupBy(F.col("scores")[0].alias("s")).agg(F.sum("tokens").alias("n")).collect()
    every = sum(r.n for r in bins)
    lam = positive_root([(r.n / every, r.s) for r in bins]) if every else model.lam
    rows = seen.where("label IS NOT NULL").withColumn("tokens", F.greatest("tokens", F.lit(1)))
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    # tokens * exp(-lambda * best) of clean documents is exponential of rate K
    fit = rows.where("label <= 0 AND size(scores) > 0").agg(F.count(F.lit(1)), F.sum(F.col("tokens") * F.exp(-lam * best))).first()
    k = max(1e-6, fit[0] / fit[1]) if fit[1] else model.k
    strength = F.transform("scores", lambda s: lam * s - F.ln(k * F.col("tokens")))
    good = F.filter("strength", lambda x: x >= -math.log(model.max_e))
    none = -F.ln(k * F.col("tokens"))
    evidence = F.greatest(F.coalesce(F.array_max("strength"), none), F.aggregate(good, F.lit(0.0), lambda a, x: a + x) + F.when(F.size(good) > 0, 0.0).otherwise(none))
    binned = rows.withColumn("strength", strength).select("label", F.round(F.least(F.greatest(evidence, F.lit(-25.0)), F.lit(60.0)), 1).alias("x"))
    histogram = binned.groupBy("x").agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
    a, b = _logistic(sorted((r.x, r.pos, r.n) for r in histogram.collect()))
    return replace(model, lam=lam, k=k, intercept=a, slope=b)


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope by Newton steps on the penalised likelihood of (x, positive, all)."""
    a, b = 0.0, 0.1
    for _ in range(100):
        ga, gb, haa, hab, hbb = -1e-3 * a, -1e-2 * b, 1e-3, 0.0, 1e-2
        for x, pos, n in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            r, w = pos - n * p, n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + r, gb + r * x, haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 4.0 / max(abs(da), 10 * abs(db), 1e-9))
        a, b = a + scale * da, b + scale * db
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, score, predicted, evidence, segments``.

    ``score`` is the calibrated probability that the label is 1, ``predicted`` is 1 from 0.5 on. ``segments`` are the maximal scoring
    passages whose E-value is at most ``model.max_e``, as code points of the text. Null and empty texts have no
    tokens and get the score of no evidence; ids may be null or repeat; an empty table gives an empty result. Texts are scanned
    whole, in linear time; no rows move.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` bigint, score double, predicted int, evidence double, segments {_KINDS}"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = _Scores(m)
        for batch in slices(batches, "text", 2 << 20):
            evidence, segments = [], []
            for e, text, good in _scan(batch.column("text").to_pylist(), m, cache):
                evidence.append(e)
                segments.append(_places(text, good))
            score = [m.probability(min(max(e, -25.0), 60.0)) for e in evidence]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(evidence, pa.float64()), pa.array(segments, kind)], names=[id_col, "score", "predicted", "evidence", "segments"]
            )

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows that the model does not call toxic, with all their columns as they are. No rows move."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = _Scores(m)
        for batch in slices(batches, text_col, 2 << 20):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([m.probability(min(max(e, -25.0), 60.0)) < 0.5 for e, _, _ in _scan(texts, m, cache)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the fold that ``fit_toxicity`` leaves out."""
    return F.crc32(F.col(id_col).cast("string")) % folds == 0
