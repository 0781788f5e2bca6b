"""Token counts against the libraries on whole texts."""

import os

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
from fixtures import MESSY

from quartzfield.llm import queries
from quartzfield.llm.tokencount import Lengths, Library, count_tokens, frequent_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
ODD = ["a<|endoftext|>b", "a <|endoftext|>  \n c", "<|endoftext|><|endoftext|>", "<|endoftext", "it's  ''s\r\n\r\n x", "\x1c\x1d \x85\xa0  　y", "é ؀١٢ ²³½ Ⅷ", "\U0001f469‍\U0001f52c x" * 5, "՘a1 \U000323b0", " " * 5000, "1" * 30_000, "\0a\0"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def counted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_every_character(library):
    """Characters of all classes and of no class in this Unicode version, beside letters, digits and spaces."""
    ours = Lengths(Library(PATH), {}, cache_size=1000)
    step = 97
    for k, a in enumerate(range(0, 0x110000, step)):
        if (0x3400 <= a < 0xA000 or 0xAC00 <= a < 0xD700 or a >= 0x20000) and k % 50:
            continue  # long runs of one class
        text = " ".join(f"a{c}1{c} .{c}" for c in map(chr, range(a, min(a + step, 0x110000))) if not "\ud800" <= c <= "\udfff")
        assert ours.of(text) == counted(library, text), hex(a)


def test_odd_texts(spark, library, make, messy, nothing):
    rows = MESSY + list(enumerate(ODD, 100))
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(make(rows), PATH, size=4).collect())
    assert got == sorted((repr(i), len((t or "").encode()), n := counted(library, t), n > 512) for i, t in rows)
    assert count_tokens(nothing, PATH).collect() == []
    assert count_tokens(make([(1, None)]), PATH).first()[1:] == (0, 0, False)


def test_long_text(library):
    text = "some words of it, " * 200_000
    assert Lengths(Library(PATH), {" of": 1}).of(text) == counted(library, text)


def test_other_files(make):
    rows = [(1, "Some Text, <|endoftext|> of words"), (2, None), (3, "l'été  où  “x”")]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        if name.endswith("json"):
            one = tokenizers.Tokenizer.from_file(path)
            want = [len(one.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
        else:
            want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for _, t in rows]
        assert [r.n_tokens for r in count_tokens(make(rows), path).orderBy("doc_id").collect()] == want


def test_frequent_pieces(make):
    """No pre-token above the bound is missed, however few counters there are and however rows lie in tasks."""
    rows = [(i, " ".join(["the"] * 40 + [f"w{i}x{k}" for k in range(30)] + ["of"] * 20)) for i in range(60)]
    got = frequent_pieces(make(rows).repartition(7), PATH, size=16, fan_in=2)
    assert {" the", " w", "x", " of"} <= set(got) and len(got) <= 16


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query(spark, library):
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(queries.op11_token_counts(spark, DATA).collect())
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), n := counted(library, r["text"]), n > 512) for r in docs)
    assert [tuple(r) for r in got] == want
