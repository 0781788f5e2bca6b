"""Repair of conversation structure: turns are aligned to alternating role strings at the least cost of edits."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_NAME = ("user", "assistant")
_FAR = 1 << 29
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1


def faults(rows: list[tuple[str, str]]) -> str:
    """The first fault of each (role, text): ``b`` blank, ``d`` role and text seen earlier, ``t`` truncated, ``-`` none."""
    out, seen = [], set()
    for row in rows:
        said = row[1].rstrip(_WHITE)
        out.append("b" if not said else "d" if row in seen else "-" if said[-1] in ".!?" else "t")
        seen.add(row)
    return "".join(out)


class _Table:
    """Wagner-Fischer costs of aligning the rows from ``i`` on to the last ``r`` roles of ``...uaua``, inside Ukkonen's band.

    All targets of the grammar end alike, so one table serves every feasible length. A path through (i, r) costs at least what the
    faults force, and 2 for each row in which ``r`` differs from the rows left that may stay; the incumbent's cost thus bounds ``r`` on
    both sides. Rows of the table are kept at every ``step``-th ``i``, those between are computed again when they are walked through.
    """

    def __init__(self, initials: str, faults: str):
        self.roles, self.n = initials, len(initials)
        self.forced = [f in "bd" for f in faults]
        self.truncated = [int(f == "t") for f in faults]
        self.left = np.concatenate((np.cumsum([not f for f in self.forced][::-1], dtype=np.int64)[::-1], [0])).tolist()
        self.width = self._slack() // 2
        self.step = max(64, isqrt(self.n))
        size = 2 * self.width + 1
        self.twice = 2 * np.arange(size, dtype=np.int64)
        last = self.twice - 2 * self.width
        row = np.where(last < 0, _FAR, last)
        self.kept, self.block = {self.n: row}, {self.n: row}
        self.first_s = [_FAR] * (self.n + 1)  # least cost if row i is the leading system turn
        for i in range(self.n - 1, -1, -1):
            if self.roles[i] == "s" and not self.forced[i]:
                even = self._even(i + 1, row, 2)
                self.first_s[i] = DELETE * i + self.truncated[i] + (int(row[even].min()) if len(even) else _FAR)
            row = self._above(i, row)
            if i % self.step == 0:
                self.kept[i] = row
            if i < self.step:
                self.block[i] = row
        self.from_s = np.minimum.accumulate(np.array(self.first_s[::-1]))[::-1].tolist()

    def _slack(self) -> int:
        """What an edit found greedily costs more than the faults force: a turn out of order gets a new role, or an empty one before it."""
        least = _FAR
        for insert in (False, True):
            cost, want, begun = 0, "u", False
            for role, forced in zip(self.roles, self.forced, strict=True):
                if forced or role == "s" and not begun:
                    begun |= not forced
                    continue
                begun = True
                if role == want or insert and role in "ua":
                    cost += 0 if role == want else INSERT
                    want = "a" if role == "u" else "u"
                else:
                    cost, want = cost + REROLE, "a" if want == "u" else "u"
            least = min(least, cost + (INSERT if want == "a" else 0))
        stay = [r for r, f in zip(self.roles, self.forced, strict=True) if not f]
        return DELETE if stay == ["s"] else min(least, DELETE * len(stay))

    def _even(self, i: int, row: np.ndarray, least: int) -> np.ndarray:
        """Places in the row of even ``r`` from ``least`` on."""
        low = self.left[i] - self.width
        start = max(least, low + (low & 1)) - low
        return np.arange(start, len(row), 2)

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row ``i`` of the table from row ``i + 1``."""
        if self.forced[i]:
            row = DELETE + below
        else:
            low = self.left[i] - self.width
            turn = np.full(len(below), REROLE + self.truncated[i])
            if self.roles[i] in "ua":
                turn[(low & 1) ^ (self.roles[i] == "a") :: 2] = self.truncated[i]
            row = below + turn
            np.minimum(row[:-1], DELETE + below[1:], out=row[:-1])
            if low < 0:
                row[:-low] = _FAR
        return np.minimum.accumulate(row - self.twice) + self.twice

    def at(self, i: int, r: int) -> int:
        k = r - self.left[i] + self.width
        if r < 0 or not 0 <= k <= 2 * self.width:
            return _FAR
        if i not in self.block:
            end = min(self.n, (i // self.step + 1) * self.step)
            self.block = {end: self.kept[end]}
            for j in range(end - 1, i // self.step * self.step - 1, -1):
                self.block[j] = self._above(j, self.block[j + 1])
        return int(self.block[i][k])

    def best(self) -> int:
        row = self.block[0]
        even = self._even(0, row, 0)
        return min(int(row[even].min()) if len(even) else _FAR, self.from_s[0])

    def audit(self) -> tuple[int, str]:
        """The least cost and, among all edits of that cost and of any length, the audit that sorts first.

        The backtraces of all targets are followed at once: those whose next letter is the least stay. They have used up the same
        rows at the same cost, so what tells them apart is the number ``r`` of roles still to come.
        """
        best = self.best()
        live = {r for r in range(0, self.left[0] + self.width + 1, 2) if self.at(0, r) == best}
        leading = self.from_s[0] == best
        out, i = [], 0
        while i < self.n or any(live):
            now = {r: self.at(i, r) for r in live}
            if i < self.n:
                gone = {r for r, c in now.items() if c == DELETE + self.at(i + 1, r)}
                ahead = leading and self.from_s[i + 1] == best
                if gone or ahead:
                    live, leading = gone, ahead
                    out.append("D")
                    i += 1
                    continue
            added = {r - 1 for r, c in now.items() if r and c == INSERT + self.at(i, r - 1)}
            if added:
                live, leading = added, False
                out.append("I")
                continue
            cost = self.truncated[i]
            stay = {r - 1 for r, c in now.items() if r and self.roles[i] == "ua"[r & 1] and c == cost + self.at(i + 1, r - 1)}
            if leading and self.first_s[i] == best:
                stay |= {r for r in range(2, self.left[i + 1] + self.width + 1, 2) if DELETE * i + cost + self.at(i + 1, r) == best}
            out.append("K" if stay else "R")
            live = stay or {r - 1 for r, c in now.items() if r and c == REROLE + cost + self.at(i + 1, r - 1)}
            leading = False
            i += 1
        return best, "".join(out)


def align(initials: str, faults: str) -> tuple[int, str]:
    """Least cost and first audit that turn rows with these role initials and faults into ``(s?(ua)+)?``."""
    return _Table(initials, faults).audit()


def apply_audit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns that an audit's letters (Keep, Rerole, Delete, Insert) leave."""
    out, i, said = [], 0, 0
    for letter in audit:
        if letter == "I":
            out.append((_NAME[said % 2], ""))
        elif letter != "D":
            out.append(rows[i] if letter == "K" else (_NAME[said % 2], rows[i][1]))
        i += letter != "I"
        said += letter in "IR" or letter == "K" and rows[i - 1][0][:1] != "s"
    return out


def repair_conversations(df: DataFrame, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``.

    Turns are ordered by their number (none first), then role and text; null roles and texts count as one space. ``gaps`` are the numbers
    missing between the first and the last turn; ``blank``, ``duplicate`` and ``truncated`` count rows by their first fault;
    ``illegal`` counts neighbours whose role initials are not su, ua or au. ``audit`` has a letter for each edit: Keep is free, Rerole to
    user or assistant costs 2, Delete 3, Insert of an empty user or assistant turn 2, a truncated row that stays 1; blank and
    duplicate rows must go. The result's initials are nothing, or an optional s and ua repeated; ties go to the audit
    that sorts first. ``repaired`` are the (role, text) that it leaves. Rows for which ``present`` is false
    are not there, but their conversation stays; one without rows has zeros and an empty audit. Rows without a conversation id form
    one conversation, repeated rows are duplicates, an empty table gives an empty result, other columns are not read.

    The turns of a conversation are gathered in lists before the shuffle and must fit a task, as its repaired text does. Aligning n turns takes
    n times the band's width, which grows with the faults alone, and memory of about the square root of n times that width.
    """
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    rows = turn if present is None else F.when(present, turn)
    talks = df.groupBy(F.col(conv_col).cast("bigint").alias("conv")).agg(F.sort_array(F.collect_list(rows)).alias("turns"))
    names = [conv_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for k, conv in enumerate(batch.column("conv").to_pylist()):
                turns = batch.column("turns")[k].as_py()
                said = [(t["role"], t["text"]) for t in turns]
                numbers = {t["turn"] for t in turns} - {None}
                gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
                found, initials = faults(said), [role[:1] for role, _ in said]
                illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
                cost, audit = align("".join(x or " " for x in initials), found)
                mended = apply_audit(said, audit)
                out.append((conv, gaps, *map(found.count, "bdt"), illegal, cost, audit, [{"role": r, "text": t} for r, t in mended]))
                size += sum(len(t) for _, t in mended)
                if size > 1 << 20 or len(out) == 1000:
                    yield packed(out)
                    out, size = [], 0
        if out:
            yield packed(out)

    counts = ", ".join(f"{n} bigint" for n in names[1:7])
    return talks.mapInArrow(run, f"`{conv_col}` bigint, {counts}, audit string, repaired array<struct<role:string,text:string>>")


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: conversations with faults that the hash of each row's place decides on.

    Of crc32(``conv_id:turn``) modulo 20 (nulls: one space), 0 drops the row (``present`` is false), 1 empties its text, 2 removes
    the characters ``.!?``, 3 repeats the row, 4 makes it the user's.
    """
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    out = df.select("conv_id", "turn", "role", text.alias("text"), F.pmod(F.crc32(place), F.lit(20)).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", space))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), times.alias("copy")).drop("copy")
