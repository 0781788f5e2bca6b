"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import MESSY, SCHEMA, rows_of

from quartzfield.llm.search import BlockedLists, _Best, ranked_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    docs = [(i, Counter(words(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    total, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1):
            out.append((repr(item), rank, None if none else i, -score))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((repr(r.item_id), r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


@pytest.fixture()
def ask(spark):
    return lambda pairs: spark.createDataFrame([(i, t, 5, "r", 0) for i, t in pairs], "item_id bigint, text string, rank int, doc_id string, score int")


def corpus(seed, count):
    r = random.Random(seed)
    texts = [" ".join(r.choice("abcdefghijklmnopqrst") * r.choice((1, 1, 2)) for _ in range(r.randint(1, 60))) for _ in range(count)]
    return [(i, r.choice(texts[: 1 + count // 4]) if r.random() < 0.3 else t) for i, t in enumerate(texts)]


def test_messy(make, ask, nothing):
    rows = [*MESSY, (11, "Été ÉTÉ été 42, x_y"), (12, "the-cat"), (12, "the-cat")]
    items = [(1, "The CAT sat"), (2, None), (3, "nowhere"), (None, "a b; c"), (None, "d"), (5, "été 42 y"), (5, "x"), (6, "été 42 y"), (7, " ")]
    assert got(ranked_search(make(rows), ask(items), k=3)) == brute(rows, items, 3)
    assert got(ranked_search(nothing, ask(items))) == []
    assert got(ranked_search(make(rows), ask([]))) == []


def test_random_ties_and_groups(make, ask):
    """Copies tie, groups of items are searched one after another, tasks settle in small parts."""
    docs = corpus(1, 300)
    items = [(i, t) for i, (_, t) in enumerate(corpus(2, 25))]
    for k, block, entries, refs in ((10, 16, 1 << 20, 1 << 20), (4, 3, 500, 60)):
        assert got(ranked_search(make(docs), ask(items), k=k, block=block, entries=entries, refs=refs, rarest=2)) == brute(docs, items, k)


def test_blocks_are_skipped():
    """Of lists of copies only the first blocks are opened, and the scores are those of all documents."""
    r = np.random.default_rng(4)
    count, width = 4000, 30
    kinds = [np.sort(r.choice(width, 8, replace=False)) for _ in range(40)]
    which = np.sort(r.integers(0, 40, count))
    term = np.concatenate([kinds[w] for w in which])
    value = np.concatenate([(kinds[w] + 1) * (w + 1) * 10 for w in which]).astype(np.int64)
    ptr = np.arange(count + 1) * 8
    lists = BlockedLists(np.arange(count), np.ones(count, np.int64), np.arange(count), ptr, term, value, width, 16)
    items = [_Best(np.sort(r.choice(width, 6, replace=False)), 10, 0, 1 << 62) for _ in range(5)]
    scores = np.zeros((count, width), np.int64)
    scores[np.repeat(np.arange(count), 8), term] = value
    wants = [scores[:, i.terms].sum(1) for i in items]
    lists.search(items)
    for item, want in zip(items, wants, strict=True):
        order = np.lexsort((np.arange(count), -want))[:10]
        assert item.found[1].tolist() == order.tolist() and item.found[0].tolist() == want[order].tolist()
    again = [_Best(i.terms, 10, i.score, i.doc) for i in items]
    blocks, opened = lists.search(again)
    assert [i.found.tolist() for i in again] == [i.found.tolist() for i in items]
    assert opened < 0.2 * blocks


def test_long_text(spark, make, ask):
    rows = [(1, "alpha beta " * 100_000 + "gamma"), (2, "alpha gamma"), (3, "delta")]
    assert got(ranked_search(make(rows), ask([(1, "Alpha gamma delta")]))) == brute(rows, [(1, "Alpha gamma delta")], 10)
    assert spark.createDataFrame(rows_of(rows), SCHEMA).count() == 3
