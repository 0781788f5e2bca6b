"""Ranked lexical search: posting lists in blocks of similar documents, skipped where their coordinatewise maxima cannot reach the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, text_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LAST = np.iinfo(np.int64).max


def terms_of(text: Column) -> Column:
    """The terms of a text in order: what stands between ASCII characters other than letters and digits, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN, -1), lambda w: w != "")


class _Best:
    """The best documents of one item so far; ``score`` and ``doc`` are those that a further one must beat."""

    def __init__(self, terms: np.ndarray, k: int, score: int, doc: int):
        self.terms, self.k, self.score, self.doc = terms, k, score, doc
        self.found = np.zeros((4, 0), np.int64)  # score, id, whether there is one, key

    def may(self, scores: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether documents of these scores, or blocks of these bounds and least ids, may be among the best."""
        return (scores > 0) & ((scores > self.score) | (scores == self.score) & (docs <= self.doc))

    def add(self, found: np.ndarray) -> None:
        every = np.concatenate((self.found, found), axis=1)
        self.found = every[:, np.lexsort((every[3], every[1], -every[0]))[: self.k]]
        if self.found.shape[1] == self.k:
            score, doc = int(self.found[0, -1]), int(self.found[1, -1])
            if score > self.score or score == self.score and doc < self.doc:
                self.score, self.doc = score, doc


class BlockedLists:
    """Posting lists of some documents that lie in order of similarity, for a set of items.

    ``ptr`` bounds each document's entries in ``term`` (positions in the items' vocabulary) and ``value``. A list's documents are cut into
    blocks of neighbours; a block's summary has the largest value of each coordinate that items with this term ask for.
    """

    def __init__(self, docs: np.ndarray, known: np.ndarray, keys: np.ndarray, ptr: np.ndarray, term: np.ndarray, value: np.ndarray, vocabulary: int, block: int):
        self.docs, self.known, self.keys, self.ptr, self.term, self.value, self.block = docs, known, keys, ptr, term, value, block
        order = np.argsort(term, kind="stable")
        self.row = np.repeat(np.arange(len(docs)), np.diff(ptr))[order]
        self.start = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.most, term, value)
        self.column = np.full(vocabulary, -1, np.int64)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of some documents, and where each document's begin among them."""
        sizes = self.ptr[rows + 1] - self.ptr[rows]
        begin = np.cumsum(sizes) - sizes
        return np.repeat(self.ptr[rows] - begin, sizes) + np.arange(int(sizes.sum())), begin

    def _summaries(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Coordinatewise maxima of the blocks of a list, for the columns set in ``self.column``; a bounded part of the list at a time."""
        step = max(1, (1 << 21) // (width * self.block)) * self.block
        out = []
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            at, begin = self._entries(some)
            column = self.column[self.term[at]]
            row = np.repeat(np.arange(len(some)), np.diff(begin, append=len(at)))
            asked = column >= 0
            cells = np.zeros((len(some), width), np.int64)
            cells[row[asked], column[asked]] = self.value[at[asked]]
            out.append(np.maximum.reduceat(cells, np.arange(0, len(some), self.block), axis=0))
        return np.concatenate(out)

    def _essential(self, item: _Best) -> np.ndarray:
        """Terms of which a document must have one to be among the best: the others' largest values together stay below."""
        there = item.terms[self.most[item.terms] > 0]
        there = there[np.argsort(self.most[there], kind="stable")]
        return there[np.cumsum(self.most[there]) >= item.score]

    def search(self, items: list[_Best]) -> tuple[int, int]:
        """Add what these documents have to the items' best; returns how many blocks there were and how many were opened."""
        asking: dict[int, list[int]] = {}
        for q, item in enumerate(items):
            for t in self._essential(item).tolist():
                asking.setdefault(t, []).append(q)
        open_rows: dict[int, list[np.ndarray]] = {}
        blocks = opened = 0
        for t, who in asking.items():
            rows = self.row[self.start[t] : self.start[t + 1]]
            columns = items[who[0]].terms if len(who) == 1 else np.unique(np.concatenate([items[q].terms for q in who]))
            self.column[columns] = np.arange(len(columns))
            summaries = self._summaries(rows, len(columns))
            first = np.minimum.reduceat(self.docs[rows], np.arange(0, len(rows), self.block))
            for q in who:
                bound = summaries[:, self.column[items[q].terms]].sum(axis=1)
                may = items[q].may(bound, first)
                blocks, opened = blocks + len(may), opened + int(may.sum())
                if may.any():
                    open_rows.setdefault(q, []).append(rows[np.repeat(may, self.block)[: len(rows)]])
            self.column[columns] = -1
        for q, parts in open_rows.items():
            item, rows = items[q], np.unique(np.concatenate(parts))
            self.column[item.terms] = 0
            for a in range(0, len(rows), 1 << 13):
                some = rows[a : a + (1 << 13)]
                at, begin = self._entries(some)
                score = np.add.reduceat(np.where(self.column[self.term[at]] == 0, self.value[at], 0), begin)
                some, score = some[good := item.may(score, self.docs[some])], score[good]
                item.add(np.stack((score, self.docs[some], self.known[some], self.keys[some])))
            self.column[item.terms] = -1
        return blocks, opened


def _blocked(items: list[tuple[int, list[int], int, int]], k: int, block: int, entries: int):
    """A function for ``mapInArrow`` that searches vectors in order of similarity; items are (number, terms, least score, its document)."""
    numbers = np.array([i for i, *_ in items], np.int64)
    vocabulary = np.unique(np.array([t for _, terms, *_ in items for t in terms], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(np.searchsorted(vocabulary, np.array(terms, np.int64)), k, score, doc) for _, terms, score, doc in items]
        parts, size = [], 0

        def settle() -> None:
            docs, known, keys, sizes, term, value = (np.concatenate(p) for p in zip(*parts, strict=True))
            at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            asked = vocabulary[at] == term
            row = np.repeat(np.arange(len(docs)), sizes)[asked]
            some = np.unique(row)  # documents without a term of these items leave
            ptr = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(docs))[some])))
            if len(some):
                BlockedLists(docs[some], known[some], keys[some], ptr, at[asked], value[asked], len(vocabulary), block).search(best)
            parts.clear()

        for batch in batches:
            docs, terms = batch.column("doc_id"), batch.column("terms")
            values = batch.column("values").flatten()
            sizes = np.diff(terms.offsets.to_numpy())
            known = np.asarray(docs.is_valid()).astype(np.int64)
            parts.append((docs.fill_null(_LAST).to_numpy(), known, batch.column("key").to_numpy(), sizes, terms.flatten().to_numpy(), values.to_numpy()))
            size += len(values)
            if size > entries:
                settle()
                size = 0
        if parts:
            settle()
        for number, item in zip(numbers.tolist(), best, strict=True):
            score, doc, known, key = item.found
            if len(score):
                ids = pa.array(doc, pa.int64(), mask=known == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), number)), ids, pa.array(key), pa.array(score)], names=["item", "doc_id", "key", "score"])

    return run


def _vectors(docs: DataFrame, item_terms: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored (key, doc_id, terms, values) of all documents that have an item's term, similar ones together, and (term, weight).

    Words are counted and joined with the items' terms on the JVM; Spark chooses the kind of join by the size of the stored terms. A word ``""`` is
    joined with for each document, so that the documents and their lengths are counted in the same pass. A document's
    leading terms are its place: those of equal direction, copies above all, become neighbours; its id splits large groups.
    """
    words = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("bigint").alias("doc_id"), terms_of(text_of(text_col)).alias("words")).where("size(words) > 0")
    words = words.select("key", "doc_id", F.size("words").cast("bigint").alias("n"), F.concat("words", F.array(F.lit(""))).alias("words"))
    words = words.select("key", "doc_id", "n", F.explode("words").alias("term"))
    ids = item_terms.select("term", "term_id").distinct().union(docs.sparkSession.sql("SELECT '' AS term, -1L AS term_id"))
    vocabulary = materialise(ids)
    counts = materialise(words.join(vocabulary, "term").groupBy("key", "doc_id", "n", "term_id").agg(F.count("*").alias("tf")))
    total, length = counts.where("term_id = -1").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    entries = counts.where("term_id >= 0")
    weights = materialise(entries.groupBy("term_id").agg(F.count("*").alias("df")).selectExpr("term_id", f"CAST(floor(1000e0 * ln((2e0 * {total} + 2e0) / (2e0 * df + 1e0))) AS BIGINT) AS weight"))
    value = F.expr(f"weight * ((1000000000 * tf) div (1000 * tf + 8 * (10 + (90 * n * {total}L) div {length}L)))")
    rows = entries.join(weights, "term_id").select("key", "doc_id", F.struct(value.alias("value"), F.col("term_id").alias("term")).alias("e")).where("e.value > 0")
    vectors = rows.groupBy("key", "doc_id").agg(F.sort_array(F.collect_list("e"), asc=False).alias("e"))
    vectors = vectors.select("key", "doc_id", F.col("e.term").alias("terms"), F.col("e.value").alias("values"))
    place = [F.get("terms", F.lit(i)) for i in range(3)] + [F.col("doc_id"), F.col("key")]
    stored = materialise(vectors.repartitionByRange(*place).sortWithinPartitions(*place))
    discard(counts, vocabulary)
    return stored, weights


def _floors(vectors: DataFrame, weights: DataFrame, item_terms: DataFrame, k: int, rarest: int) -> DataFrame:
    """(item, score, doc): the k-th best of the documents that stand highest in the lists of an item's ``rarest`` heaviest terms.

    Any documents give a valid floor; it only decides how much is skipped.
    """
    heavy = item_terms.join(weights, "term_id").where("weight > 0").withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("weight"), "term_id"))).where(F.col("n") <= rarest)
    spread = vectors.select("key", "doc_id", F.explode(F.arrays_zip("terms", "values")).alias("e")).select("key", "doc_id", F.col("e.terms").alias("term_id"), F.col("e.values").alias("value"))
    high = Window.partitionBy("term_id").orderBy(F.desc("value"), F.col("doc_id").asc_nulls_last(), "key")
    champions = spread.join(heavy.select("term_id").distinct(), "term_id").withColumn("n", F.row_number().over(high)).where(F.col("n") <= k)
    pairs = heavy.select("item", "term_id").join(champions.select("term_id", "key"), "term_id").select("item", "key").distinct()
    scored = pairs.join(spread, "key").join(item_terms.select("item", "term_id"), ["item", "term_id"]).groupBy("item", "key", "doc_id").agg(F.sum("value").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "key")
    return scored.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("item", "score", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block: int = 16, rarest: int = 12, entries: int = 1 << 20, refs: int = 1 << 20) -> DataFrame:
    """The ``k`` documents of the highest scores above 0 for each item: ``item_col, rank, doc_id, score``.

    A document's score is the sum over the item's different terms of integer weight (rarer terms weigh more) times a saturating share of
    the term's count against the document's length; equal scores go by the smaller id, then by row. Every document is
    indexed by the terms that items ask for. Tasks hold neighbours by similarity; a term's list is cut into blocks of ``block`` documents
    with the largest value of each coordinate, and a block is opened for an item only if the sum of those bounds may reach the item's k-th best so far; the
    opened blocks' documents are scored in full, so results are exact whatever is skipped.

    Null texts have no terms. Rows of documents count each for itself, also with equal or no ids (none counts as the
    largest); items of one id are one item of all their terms, those without an id as well. Items without terms, or
    none of whose terms is in a document, give no rows; nor do empty tables. Other columns are not read.

    Items are dealt into groups of about ``refs`` terms (16 MB), one search of the stored vectors for each, so what is broadcast is bounded; texts are
    read once. A task holds about ``entries`` entries of documents at a time.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("id"), F.explode(terms_of(text_of(query_col))).alias("term")).groupBy("id").agg(F.collect_set("term").alias("terms"))
    asked = materialise(asked.withColumn("item", F.monotonically_increasing_id()))
    spelt = asked.select("item", F.explode("terms").alias("term"))
    ids = materialise(spelt.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    item_terms = materialise(spelt.join(ids, "term").select("item", "term", "term_id"))
    vectors, weights = _vectors(docs, item_terms, id_col, text_col)
    known = item_terms.join(weights, "term_id").groupBy("item").agg(F.collect_list("term_id").alias("terms"))
    known = known.join(_floors(vectors, weights, item_terms, k, rarest), "item", "left")
    known = materialise(known.select("item", "terms", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("doc", F.lit(_LAST)).alias("doc")))
    groups = -(-(known.agg(F.sum(F.size("terms"))).first()[0] or 0) // refs)
    found = []
    for g in range(groups):
        some = [(r.item, list(r.terms), r.score, r.doc) for r in known.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()]
        if some:
            shared = spark.sparkContext.broadcast(some)

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                return _blocked(shared.value, k, block, entries)(batches)

            found.append(materialise(vectors.mapInArrow(run, "item bigint, doc_id bigint, key bigint, score bigint")))
            shared.unpersist()
    if not found:
        found = [spark.createDataFrame([], "item bigint, doc_id bigint, key bigint, score bigint")]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rank = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "key")
    top = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    discard(vectors, weights, known, ids, item_terms)
    return top.join(asked.select("item", F.col("id").alias(item_col)), "item").select(item_col, "rank", "doc_id", "score")
