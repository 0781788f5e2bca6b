"""The registered text queries and the pipeline on the smallest given tables, against SQL and brute force."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from fixtures import SCHEMA, base_of, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from quartzfield.llm import queries
from quartzfield.llm.bpe import load_ranks
from quartzfield.llm.common import table
from quartzfield.llm.licenses import TEMPLATES
from quartzfield.llm.secrets import KINDS

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = [sorted(map(repr, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None))) for df in (ours, theirs)]
    assert rows[0] == rows[1]


def test_substring_query(spark, docs):
    first, window = {}, 50
    words = {i: t.encode().split() for i, t in docs.items()}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    for r in queries.op2_substring_dedup(spark, DATA).collect():
        w, gone = words[r.doc_id], set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < r.doc_id:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_suffix_query(spark, docs):
    raw = {i: t.encode() for i, t in docs.items()}
    count = Counter(b[s : s + 200] for b in raw.values() for s in range(len(b) - 199))
    for r in queries.op9_suffix_array_dedup(spark, DATA).collect():
        b = raw[r.doc_id]
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))


def near_components(docs, size):
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= max(len(x), len(y)) * 80 and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_query(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_minhash_near_dedup(spark, DATA).collect()}
    assert got == near_components(docs, 2)


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=load_ranks(queries.RANK_FILE), special_tokens={})


def encoded(encoder, text):
    ids = encoder.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe_query(spark, docs, encoder):
    for r in queries.op4_byte_bpe(spark, DATA).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == encoded(encoder, docs[r.doc_id])


def least_edits(items, text):
    """Fewest edits with which each item ends somewhere in a text: Sellers' table, a column for all items at a time."""
    size = max(map(len, items))
    pattern = np.array([[ord(c) for c in t.ljust(size, "\0")] for t in items])
    row = np.arange(size + 1)
    column = np.tile(row, (len(items), 1))
    ends = np.array([len(t) for t in items])
    best = ends.copy()
    for c in text:
        moved = np.zeros_like(column)
        moved[:, 1:] = np.minimum(column[:, :-1] + (pattern != ord(c)), column[:, 1:] + 1)
        column = np.minimum.accumulate(moved - row, axis=1) + row
        best = np.minimum(best, column[np.arange(len(items)), ends])
    return best


def test_leak_query(spark, docs):
    """Pairs and their distances are those of the edit distance at every place of every document."""
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()}
    assert min(map(len, items.values())) >= 24
    got = {}
    for r in queries.op1_decontamination(spark, DATA).collect():
        got[r.doc_id, r.item_id] = min(r.distance, got.get((r.doc_id, r.item_id), 1 << 30))
    want = {}
    for d, text in docs.items():
        for (i, t), edits in zip(items.items(), least_edits(list(items.values()), " ".join(text.lower().split())).tolist(), strict=True):
            if edits <= int(len(t) * 0.08):
                want[d, i] = edits
    assert want and got == want


def test_secret_query(spark, docs):
    for r in queries.op7_secret_scan(spark, DATA).collect():
        base = base_of(docs[r.doc_id])
        want = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in spans if x[0] != "cnn"] == [x.split(":") for x in want.split(",") if x]
        assert all(int(x[2]) - int(x[1]) >= 12 for x in spans if x[0] == "cnn")


def test_licence_query(spark, docs):
    """Lines that are a template's text are found and confirmed, with few others."""
    known = {t: f for f, texts in TEMPLATES.items() for t in texts}
    want = {(i, n, known[line]) for i, t in docs.items() for n, line in enumerate(t.split("\n")) if line in known}
    got = queries.op8_license_scan(spark, DATA).collect()
    sure = {(r.doc_id, r.paragraph, r.family) for r in got if r.confirmed}
    assert want and want <= sure and len(sure) <= 1.1 * len(want) + 2
    assert {r.doc_id for r in got} <= set(docs)


def test_toxicity_query(spark, docs):
    """Held-out accuracy at scale factor 0.01; the smallest table has too few labels."""
    data = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    got = queries.op10_toxicity(spark, data).collect()
    assert len(got) == pq.read_table(f"{data}/documents.parquet", columns=["doc_id"]).num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r.predicted == toxic[r.doc_id] for r in got if r.held_out and toxic.get(r.doc_id) is not None]
    assert len(held) > 50 and sum(held) / len(held) > 0.95


def test_pipeline_stages(spark, docs):
    source = table(spark, DATA, "documents")
    toxic = corpus_pipeline.toxicity(spark, source, DATA)
    assert toxic.columns == source.columns
    exact = {r.doc_id for r in corpus_pipeline.exact(spark, source, DATA).collect()}
    groups = {}
    for i, t in docs.items():
        key = "".join(t.encode().decode().translate(dict.fromkeys(map(ord, " \t\n\x0b\f\r"))))
        groups[key] = min(groups.get(key, (1, 0)), (-len(t), i))
    assert exact == {i for _, i in groups.values()}
    near = {r.doc_id for r in corpus_pipeline.near(spark, source, DATA).collect()}
    assert near == {i for i, (_, c) in near_components(docs, 5).items() if i == c}
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, source, DATA).collect()}
    leaks = {r.doc_id for r in queries.op1_decontamination(spark, DATA).collect()}
    assert clean == set(docs) - leaks


def test_pipeline_run(spark, docs, encoder):
    """The whole run against brute force behind the toxicity model, of which only the decisions are taken."""
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, table(spark, DATA, "documents"), DATA).collect()}
    groups = {}
    for i in left:
        key = "".join(docs[i].translate(dict.fromkeys(map(ord, " \t\n\x0b\f\r"))))
        groups[key] = min(groups.get(key, (1, 0)), (-len(docs[i]), i))
    left = {i for _, i in groups.values()}
    left = {i for i, (_, c) in near_components({i: docs[i] for i in left}, 5).items() if i == c}
    left -= {r.doc_id for r in queries.op1_decontamination(spark, DATA).where("item_chars >= 24").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: encoded(encoder, docs[i]) for i in left} and len(got) > 50


def test_pipeline_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "another text of some words"), (None, "a b  c d e f g"), (None, "some words that only stand here"), (None, "some words that only stand here"), (2, "a b c d e f g ")]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    kept = sorted(r.text for r in corpus_pipeline.exact(spark, docs, DATA).collect())
    assert kept == sorted(["a b c d e f g ", "another text of some words", "some words that only stand here"])
    near = sorted((r.doc_id is None, r.text) for r in corpus_pipeline.near(spark, docs, DATA).collect())
    assert near == [(False, "a b c d e f g"), (False, "another text of some words"), (True, "some words that only stand here")]


def test_pipeline_keys_that_collide(spark, monkeypatch):
    """With a key that tells no rows apart every text stays."""
    monkeypatch.setattr(corpus_pipeline, "_keyed", lambda docs: docs.withColumn("_key", F.lit(5).cast("bigint")))
    rows = [(i, f"text {i} of its own words {i * 7} {i * 13}") for i in range(8)] + [(3, "a second text under one id"), (None, "and one without")]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        assert {r.text for r in stage(spark, docs, DATA).collect()} == {t for _, t in rows}


def test_stages_take_messy_tables(spark, messy, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (messy, nothing):
            out = stage(spark, docs, DATA)
            assert name == "byte_bpe" or out.columns == docs.columns
            assert out.count() <= docs.count()
