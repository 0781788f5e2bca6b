"""Decontamination, BPE, chat formatting, secrets, licences and toxicity."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import MESSY, base_of

from quartzfield.llm import bpe, chat, decontam, licenses, secrets, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_myers():
    r = random.Random(3)
    for _ in range(150):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        budget = r.randint(0, 4)
        best = min((distance(p, t[a:b]) for a in range(len(t) + 1) for b in range(a, len(t) + 1)), default=len(p))
        got = decontam.best_match(p, t, budget)
        assert (got[0] if got else None) == (best if best <= budget and best < len(p) else None) or (got is None and best == len(p))


def test_leaks(make, spark, messy, nothing):
    item = "which of the following rivers flows through the largest number of countries in europe"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "short"), (3, None), (None, item), (4, "A different question that nobody asks here, is it?")], "item_id bigint, text string")
    edited = item.replace("rivers", "rivvers").replace("number", "nmber").upper().replace(" ", "\n ", 3)
    docs = [(1, "before " * 50 + item + " after"), (2, "x " + edited + " y"), (3, item[:50] + " something else"), (None, item), (4, None), (5, item + " and again " + item)]
    got = [(r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(make(docs), bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 0), (2, 1, 2), (None, 1, 0), (5, 1, 0), (5, 1, 0)], key=str)
    one = decontam.find_leaks(make(docs), bench).where("doc_id = 1").first()
    assert one.passage == item and one.end - one.start == len(item)
    many = decontam.find_leaks(make(docs), bench, block_chars=60)
    assert many.count() == len(got)
    assert sorted(r.doc_id for r in decontam.drop_leaks(make(docs), bench).collect()) == [3, 4]
    assert decontam.find_leaks(messy, bench).count() == 0 and decontam.drop_leaks(messy, bench).count() == len(MESSY)
    assert decontam.find_leaks(nothing, bench).count() == 0 and decontam.find_leaks(messy, bench.where("false")).count() == 0
    assert decontam.drop_leaks(messy, bench.where("false")).columns == messy.columns


def test_leaks_of_short_items_and_in_a_row(make, spark):
    item = "what is the name of the largest lake in the country"
    bench = spark.createDataFrame([(1, item), (2, "Capital of France?"), (3, "cat")], "item_id bigint, text string")
    docs = [(1, f"{item}{item} {item.replace('lake', 'lkae')}"), (2, "the capital of  france? of course"), (3, "concatenate cats, a cat."), (4, item.replace("name", "nam") * 3)]
    got = sorted((r.doc_id, r.item_id, r.start, r.distance) for r in decontam.find_leaks(make(docs), bench).collect())
    n = len(item)
    assert got == [(1, 1, 0, 0), (1, 1, n, 0), (1, 1, 2 * n + 1, 2), (2, 2, 4, 0), (3, 3, 20, 0), (4, 1, 0, 1), (4, 1, n - 1, 1), (4, 1, 2 * n - 2, 1)]
    assert {r.doc_id for r in decontam.drop_leaks(make(docs), bench).collect()} == {2, 3}


def test_leaks_against_edit_distance(make, spark):
    r = random.Random(12)
    items = ["".join(r.choice("abcdef ") for _ in range(40)).strip().ljust(30, "x") for _ in range(12)]
    items = [" ".join(i.split()) for i in items]
    docs = []
    for k in range(60):
        text = "".join(r.choice("abcdef ") for _ in range(r.randint(0, 120)))
        if k % 2:
            own = list(r.choice(items))
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = r.choice(["", "z", "qq"])
            at = r.randint(0, len(text))
            text = text[:at] + "".join(own) + text[at:]
        docs.append((k, text))

    def least(p, t):  # Sellers' table, the fewest edits of p against any part of t
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            before, row[0] = row[0], 0
            for i, x in enumerate(p, 1):
                before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (x != c))
            best = min(best, row[-1])
        return best

    want = {(d, i) for d, t in docs for i, p in enumerate(items) if least(p, decontam.normalise(t)) <= int(len(p) * 0.08)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.find_leaks(make(docs), bench).collect()} == want and len(want) > 10


def test_pieces_cover():
    for n in (1, 7, 30):
        for e in range(n):
            parts = decontam.pieces_of("x" * n, e)
            assert len(parts) == e + 1 and sum(len(p) for _, p in parts) == n and all(p for _, p in parts)


def test_bpe(spark, messy, nothing):
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Bpe(ranks, PATTERN, cache_size=50)
    r = random.Random(1)
    alphabet = "abcdefgh   \n\t\r\x0b\x1c\x85\xa0 'stréñ123½²٣.,!?—你好😀ſK"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(400)] + ["a" * 700, "ab" * 400, "", "\x00\x01", "x" * 255, "x" * 257]
    for some in (texts[:200], texts[200:]):
        for t, ids in zip(some, mine.encode_batch(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and mine.decode(ids) == t.encode()
    got = bpe.bpe_encode(messy, PATH, PATTERN, decode=True).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, bytes(x.decoded)) for x in got) == sorted((i is None, i or 0, (t or "").encode()) for i, t in MESSY)
    assert all(x.n_tokens * 4 == len(x.ids) for x in got)
    again = bpe.bpe_decode(bpe.bpe_encode(messy, PATH, PATTERN), PATH, PATTERN).where("doc_id = 8").first()
    assert bytes(again.decoded).decode() == dict(MESSY)[8]
    assert bpe.bpe_encode(nothing, PATH, PATTERN).count() == 0


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")


def test_chat(spark):
    fixed = "</s>[INST] ok [/INST] &amp; <s>[x]\n"
    rows = [(1, 1, "assistant", fixed), (1, 0, "user", None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (2, None, None, "a"), (None, 0, "user", "b"), (3, 0, "we]ird\n[role", fixed)]
    df = talks(spark, rows)
    out = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert got[1].said == f"user\n\nassistant\n{fixed}\nassistant\n\nassistant\n\n" and got[1].learnt == fixed and got[1].n_turns == 4
    assert got[2].said == "\na\n" and got[None].said == "user\nb\n" and got[3].said == f"we]ird\n[role\n{fixed}\n"
    full = {r.conv_id: r for r in chat.format_chat(df, context=None).collect()}
    assert {r.conv_id: r.formatted for r in out.collect()} == {k: v.formatted for k, v in full.items()}
    assert all(r.rewritten_at is None for r in full.values())
    assert chat.format_chat(df.where("false")).count() == 0


def test_chat_detects_rewriting(spark):
    def forgetful(turns, prompt_role=None):  # hides the texts of all turns but the last two
        out = "".join(f"<{r}>{t if k >= len(turns) - 2 else '...'}\n" for k, (r, t) in enumerate(turns))
        return out if prompt_role is None else out + f"<{prompt_role}>"

    df = talks(spark, [(1, k, "user", f"text {k}") for k in range(5)] + [(2, 0, "user", "a"), (2, 1, "assistant", "b")])
    got = {r.conv_id: r for r in chat.format_chat(df, forgetful).collect()}
    assert got[1].rewritten_at == 2 and not got[1].turns and got[2].rewritten_at is None
    assert got[2].formatted[got[2].loss[0].start : got[2].loss[0].end] == "b"


def test_chat_long(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(3000)]
    got = chat.read_back(chat.format_chat(talks(spark, rows))).first()
    assert got.n_turns == 3000 and got.learnt == "".join(f"t{k}" for k in range(1, 3000, 2))


def test_secret_patterns():
    r = random.Random(2)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ": ", '"', "'", " ", "abcdef", "0123456789abcdef", "AKIA", "ABCDEF123456", "XYZ", "\n", "ſecret", "toKen", "-_./+", "é"]
    for _ in range(500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert secrets.base_spans(text) == base_of(text), text


def test_secret_scan(spark, make, messy, nothing):
    r = random.Random(8)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    docs = [(i, f'some words before token = "{h}" and after, on 2024-01-{i % 28 + 1:02d}T10:00:00 at 10.{i % 250}.3.{i % 99}.121') for i, h in enumerate(hexes)]
    docs.append((999, "unlabelled " + "".join(r.choice("0123456789ABCDEF") for _ in range(40)) + " value"))
    df = make(docs)
    net = secrets.fit_secrets(df)
    assert net is not None and 0.5 <= net.threshold <= 1
    got = {x.doc_id: x.findings for x in secrets.scan_secrets(df, net).collect()}
    for i, t in docs:
        base = [(f.start, secrets.KINDS.index(f.kind), f.end) for f in got[i] if f.kind != "cnn"]
        assert base == base_of(t)
    held = [f for i in range(200) for f in got[i] if f.kind == "cnn"]
    assert len(held) <= 4  # dates and addresses are not secrets
    assert all(len(x.findings) == 0 for x in secrets.scan_secrets(messy, net).collect()) and secrets.scan_secrets(messy, None).count() == len(MESSY)
    assert secrets.scan_secrets(nothing, net).count() == 0 and secrets.fit_secrets(nothing) is None


def test_network_gradient():
    x = secrets.encode(secrets.windows_of("some text token1234567890abc and more", 10, 28))
    y, w = np.ones(len(x)), np.ones(len(x))
    net = secrets.CharCnn.new()

    def loss():
        return float(np.mean(np.log1p(np.exp(-net.logits(x)))))

    grads, _ = net._gradient(x, y, w)
    for name, at in (("kernel", (3, 2)), ("out", (5,)), ("bias", (1,)), ("embed", (ord("t"), 0))):
        a = getattr(net, name)
        old = a[at]
        a[at] = old + 1e-5
        up = loss()
        a[at] = old - 1e-5
        down = loss()
        a[at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5


def test_long_candidate_is_read_whole():
    parts = secrets.windows_of("a" * 20 + "1" * 200 + " end", 20, 220)
    assert sum(p[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE].rstrip("\0").count("1") for p in parts) == 200


def test_licenses(make, messy, nothing):
    plain = [(100 + i, f"plain paragraph number {i} about nothing in particular\nand a second line {i}") for i in range(60)]
    docs = [(1, "text\nReleased under the MIT License.\nmore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "licensed under the apache license, version 2.0"), (5, None), (None, "All rights reserved."), (6, "the licence of poets is under the stars")]
    df = make(docs + plain)
    model = licenses.fit_licenses(df, max_paragraphs=400)
    got = licenses.scan_licenses(df, model).collect()
    sure = {(r.doc_id, r.paragraph, r.family) for r in got if r.confirmed}
    assert sure == {(1, 1, "mit"), (2, 0, "gpl"), (3, 0, "cc-by-nc"), (4, 0, "apache-2.0"), (None, 0, "proprietary")}
    assert not [r for r in got if r.doc_id and r.doc_id >= 100]
    assert licenses.scan_licenses(messy, model).where("confirmed").count() == 0 and licenses.scan_licenses(nothing, model).count() == 0
    assert licenses.scan_licenses(df, licenses.fit_licenses(nothing)).where("confirmed").count() >= 5


def test_segments_by_brute_force():
    r = random.Random(6)
    for _ in range(200):
        scores = [r.choice([-2.0, -1.0, 1.0, 2.0, 0.5]) for _ in range(r.randint(0, 12))]

        def best(a, b, scores=scores):  # Ruzzo and Tompa's recursive definition, shortest of the best
            spans = [(sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not spans or max(spans)[0] <= 0:
                return []
            s, _, _, i, j = max(spans)
            return [*best(a, i), (i, j, s), *best(j, b)]

        got = toxicity.maximal_segments(scores)
        assert abs(sum(s for *_, s in got) - sum(s for *_, s in best(0, len(scores)))) < 1e-9
        assert all(abs(sum(scores[a:b]) - s) < 1e-9 for a, b, s in got)
        assert max((s for *_, s in got), default=0) == max((s for *_, s in best(0, len(scores))), default=0)


def test_toxicity(spark, make, messy, nothing):
    r = random.Random(9)
    words = [f"word{k}" for k in range(400)]
    docs, marks = [], []
    for i in range(600):
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        bad = i % 6 == 0
        if bad:
            text[5:5] = ["nastystem" + r.choice(["a", "en", "ing"]), "you", "vile"]
        docs.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    df, labels = make(docs), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    got = {x.doc_id: x for x in toxicity.score_toxicity(df, model).collect()}
    held = {x.doc_id for x in df.where(toxicity.held_out()).collect()}
    right = [(got[i].predicted == y) for i, y in marks if i in held]
    assert len(held) > 60 and sum(right) / len(right) > 0.97
    one = next(got[i] for i, y in marks if y and got[i].segments)
    assert "nasty" in docs[one.doc_id][1][one.segments[0].start : one.segments[0].end]
    assert {x.doc_id for x in toxicity.drop_toxic(df, model).collect()} == {i for i in got if not got[i].predicted}
    # labels of the held-out fold change nothing
    turned = labels.withColumn("toxic", (1 - labels.toxic))
    other = labels.where(~toxicity.held_out()).unionByName(turned.where(toxicity.held_out()))
    assert toxicity.fit_toxicity(df, other).scores == model.scores
    for m in (model, toxicity.fit_toxicity(nothing, labels), toxicity.fit_toxicity(df, labels.where("toxic = 0")), toxicity.fit_toxicity(df, labels.where("false"))):
        out = toxicity.score_toxicity(messy, m).collect()
        assert len(out) == len(MESSY) and all(0 <= x.score <= 1 for x in out)
        assert toxicity.score_toxicity(nothing, m).count() == 0 and toxicity.drop_toxic(messy, m).columns == messy.columns




def test_vocabularies_of_other_kinds():
    """A token that merges do not reach, a byte without a token, ids that are too large, and a cache that keeps short pieces only."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    own, theirs = bpe.Bpe(ranks, r"\w+|\s+"), tiktoken.Encoding("own", pat_str=r"\w+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abc abcd", "ab c"):
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == theirs.encode_ordinary(text)
    with pytest.raises(ValueError, match="no token for a byte"):
        bpe.Bpe({b"a": 0, b"b": 1}, r"\w+").encode_batch(["abz"])
    with pytest.raises(ValueError, match="below"):
        bpe.Bpe({b"a": 1 << 20}, r"\w+")
    own.encode_batch(["x" * 20_000 + " abc"])
    assert max(map(len, own.cache)) <= 64
