"""Whole jobs: what earlier versions of the text operators left out."""

import random

from quartzfield.llm import chat, licenses, secrets


def test_secret_threshold_keeps_recall(make):
    r = random.Random(4)
    docs = []
    for i in range(400):
        day = f"2024-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(10, 23)}"
        hexed = "".join(r.choice("0123456789abcdef") for _ in range(40))
        docs.append((i, f"plain {' ' * 20}{day}-{i} and token = {hexed}"))
        if i % 10 == 0:  # the window does not reach the name, so nothing tells these from plain dates
            docs.append((1000 + i, f"token ={' ' * 20}{day}-{i} and tokens"))
    net = secrets.fit_secrets(make(docs))
    above, total = net.measured
    assert total > 60 and above >= 0.99 * total and net.threshold < 0.5
    rated = [max(net.probability(secrets.encode(secrets.windows_of(t, a, b)))) for _, t in docs for a, b in secrets.candidates(t) if secrets.Covered(secrets.base_spans(t)).label(a, b)]
    assert sum(p >= net.threshold for p in rated) >= 0.98 * len(rated)


def test_secret_threshold_reads_the_whole_table(make):
    r = random.Random(5)
    docs = [(i, f"token = {r.getrandbits(160):040x} or 10.{i % 250}.3.{i % 99}.121") for i in range(300)]
    net = secrets.fit_secrets(make(docs), max_examples=40)
    assert net.measured[1] >= 300 - 40


def test_secret_candidates_are_all_rated(make):
    net = secrets.CharCnn.new()
    net.threshold = 0.0
    text = "use correcthorsebatterystaple here, mytoken=abcdefgh12345678 there, token: abcdefghijklmnop"
    found = secrets.scan_secrets(make([(1, text)]), net).first().findings
    assert [text[f.start : f.end] for f in found if f.kind == "cnn"] == ["correcthorsebatterystaple", "mytoken=abcdefgh12345678"]
    assert [text[f.start : f.end] for f in found if f.kind == "assign"] == ["token=abcdefgh12345678", "token: abcdefghijklmnop"]


def test_licence_rating_does_not_depend_on_common_words(make):
    words = "released into the public domain notes were later by a small library".split()
    plain = [(100 + i, " ".join(r.sample([w for w in words if w != "domain" or i % 2], 6)) + f" {i}") for r in [random.Random(6)] for i in range(400)]
    plain = [(i, t.replace("public domain", "domain public")) for i, t in plain]
    df = make([(1, "Released into the public domain."), *plain])
    got = licenses.scan_licenses(df, licenses.fit_licenses(df)).where("doc_id = 1").collect()
    assert [(r.family, r.confirmed) for r in got] == [("cc0", True)]


def test_licence_notice_over_several_lines(make):
    wrapped = "intro\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files,\nto deal in the Software\nwithout restriction.\nand prose behind"
    df = make([(1, wrapped), *((100 + i, f"plain line number {i}\nwith another one {i * 7}") for i in range(200))])
    got = licenses.scan_licenses(df, licenses.fit_licenses(df)).collect()
    assert [(r.doc_id, r.paragraph, r.lines, r.family) for r in got if r.confirmed and r.overlap == 1.0] == [(1, 1, 4, "mit")]
    assert {r.doc_id for r in got} == {1}


def test_licence_lines_without_cues_stay_below_a_half():
    r = random.Random(3)
    for _ in range(200):
        vocabulary = [f"w{i}" for i in range(8)] + ["w0 w1", "w2 w3"]
        weights, bias = [[r.uniform(-2, 2) for _ in vocabulary] for _ in range(3)], [r.uniform(0, 6), r.uniform(-2, 2), r.uniform(-2, 2)]
        cues = licenses.cue_words(vocabulary, weights, bias)
        left = [i for i, f in enumerate(vocabulary) if not set(f.split()) & set(cues)]
        for k in (1, 2):
            margin = bias[k] - bias[0] + sum(max(0.0, weights[k][i] - weights[0][i]) for i in left)
            assert margin < 1e-6 or bias[k] > bias[0]


def test_licence_threshold_counts_every_line():
    counts = {10: 900, 60_000: 99, 90_000: 1}
    assert 0.6 < licenses.quiet_threshold(counts, 0.001) < 0.9 and 0.1e-3 < licenses.quiet_threshold(counts, 0.1) < 0.6
    assert licenses.quiet_threshold({}, 0.001) == 0


def test_chat_detects_rewriting_that_the_end_undoes(spark):
    def forgetful(turns, prompt_role=None):  # hides all but the last two turns while a user speaks last
        hides = bool(turns) and turns[-1][0] == "user"
        out = "".join(f"<{r}>{'...' if hides and k < len(turns) - 2 else t}\n" for k, (r, t) in enumerate(turns))
        return out if prompt_role is None else out + f"<{prompt_role}>"

    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], f"text {k}") for k in range(6)], "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_chat(df, forgetful).first()
    assert got.rewritten_at == 2 and not got.turns and not got.loss
