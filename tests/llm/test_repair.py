"""Repair of conversations against all edits of least cost."""

import hashlib
import os
import random
import re
import time
import zlib

import pyarrow.parquet as pq
import pytest

from quartzfield.llm import queries
from quartzfield.llm.repair import align, apply_audit, faults, repair_conversations

DATA = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")
#: next state of the grammar by state and initial; a result may end in "0" (nothing said) and "a"
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def all_least(initials, found):
    """Least cost and all audits of that cost, by states of the grammar; at most two inserts stand together in a cheapest edit."""
    states = {"0": (0, {""})}

    def put(into, state, cost, audits):
        old = into.get(state, (1 << 30, set()))
        if cost < old[0]:
            into[state] = (cost, set(audits))
        elif cost == old[0]:
            old[1].update(audits)

    def inserted(states):
        out = {}
        for state, (cost, audits) in states.items():
            at, letters = state, ""
            for k in range(3):
                put(out, at, cost + 2 * k, {a + letters for a in audits})
                letters += "I"
                at = NEXT.get((at, "u")) or NEXT.get((at, "a"))
        return out

    for role, fault in zip(initials, found, strict=True):
        states, after = inserted(states), {}
        for state, (cost, audits) in states.items():
            put(after, state, cost + 3, {a + "D" for a in audits})
            if fault in "bd":
                continue
            more = fault == "t"
            if (state, role) in NEXT:
                put(after, NEXT[state, role], cost + more, {a + "K" for a in audits})
            for new in "ua":
                if (state, new) in NEXT:
                    put(after, NEXT[state, new], cost + 2 + more, {a + "R" for a in audits})
        states = after
    ends = [v for k, v in inserted(states).items() if k in "0a"]
    cost = min(c for c, _ in ends)
    return cost, set().union(*(a for c, a in ends if c == cost))


def test_align_all_small():
    r = random.Random(3)
    for _ in range(4000):
        n = r.randint(0, 9)
        initials = "".join(r.choice("uuuaaas ") for _ in range(n))
        found = "".join(r.choice("-----tbd") for _ in range(n))
        cost, audits = all_least(initials, found)
        assert align(initials, found) == (cost, min(audits)), (initials, found)


def test_align_long():
    """Blocks of the table are computed again; the cost equals that of the states, the result fits the grammar."""
    r = random.Random(5)
    for n in (63, 64, 65, 200, 700):
        initials = "s" + "".join("ua"[k % 2] if r.random() > 0.2 else r.choice("uas") for k in range(n - 1))
        found = "".join(r.choice("--------tbd") for _ in range(n))
        cost, audit = align(initials, found)
        least = {"0": 0}
        for role, fault in zip(initials, found, strict=True):
            grown = dict(least)
            for _ in range(2):
                for s, c in list(grown.items()):
                    to = NEXT.get((s, "u")) or NEXT.get((s, "a"))
                    grown[to] = min(grown.get(to, 1 << 30), c + 2)
            after = {s: c + 3 for s, c in grown.items()}
            for s, c in grown.items():
                for new in () if fault in "bd" else "usa":
                    if (s, new) in NEXT and (new == role or new != "s"):
                        to = NEXT[s, new]
                        after[to] = min(after.get(to, 1 << 30), c + (fault == "t") + 2 * (new != role))
            least = after
        assert cost == min(least.get("0", 1 << 30), least.get("a", 1 << 30), least.get("u", 1 << 30) + 2)
        rows = [({"u": "user", "a": "assistant", "s": "system"}[c], str(k)) for k, c in enumerate(initials)]
        assert GRAMMAR.fullmatch("".join(x[0][0] for x in apply_audit(rows, audit)))


def test_very_long_conversation():
    began = time.time()
    n = 5000
    cost, audit = align("".join("ua"[(k // 7 + k) % 2] for k in range(n)), "-" * n)
    assert len(audit) - audit.count("I") == n and cost > 0 and time.time() - began < 60


def damaged(rows):
    out = []
    for r in rows:
        show = [" " if v is None else str(v) for v in (r["conv_id"], r["turn"])]
        kind = zlib.crc32(":".join(show).encode()) % 20
        role, text = " " if r["role"] is None else r["role"], " " if r["text"] is None else r["text"]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(r["turn"], "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))


def expected(rows):
    after = damaged(rows)
    said = [(role, text) for _, role, text in after]
    found = []
    for k, (role, text) in enumerate(said):
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("b" if not marks else "d" if (role, text) in said[:k] else "t" if marks[-1] not in ".!?" else "-")
    turns = [t for t, _, _ in after if t is not None]
    initials = [role[:1] for role, _ in said]
    cost, audits = all_least([x or " " for x in initials], found)
    mended = apply_audit(said, min(audits))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest()
    return gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, min(audits), digest


def same(spark, path, rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["conv_id"], []).append(r)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, path).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == {c: expected(g) for c, g in groups.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query(spark):
    same(spark, DATA, pq.read_table(f"{DATA}/conversations.parquet").to_pylist())


def test_query_on_messy_rows(spark, tmp_path):
    r = random.Random(9)
    words = [None, "", " \n", "Yes.", "Yes.", "no", "What? ", "...", "é!", "end\x1c", "a:b\nc."]
    rows = [(r.choice([None, *range(60)]), r.choice([None, *range(-3, 6)]), r.choice(["user", "assistant", "system", "tool", "", None, "User"]), r.choice(words), "x", 1) for _ in range(300)]
    rows.append((1000, 2 ** 40, "user", "long " * 50_000 + ".", "x", 1))
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit string, cost int").write.parquet(f"{tmp_path}/conversations.parquet")
    same(spark, str(tmp_path), [dict(zip(("conv_id", "turn", "role", "text"), x[:4], strict=True)) for x in rows])


def test_empty_table_and_copies(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert repair_conversations(spark.createDataFrame([], schema)).collect() == []
    row = repair_conversations(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 0, "user", "Hi.")], schema)).first()
    assert (row.duplicate, row.cost, row.audit) == (1, 5, "DDI") or (row.cost, row.audit) == (5, "KDI")
    assert faults([("user", "Hi."), ("user", "Hi.")]) == "-d"
