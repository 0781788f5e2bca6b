"""Chat formatting with a template that is only called, never looked into: spans come from comparing successive renderings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: render(turns, prompt_role): the text of (role, text) turns; with a prompt role also what stands before that role's text.
Render = Callable[[list[tuple[str, str]], str | None], str]

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
_ROLE_ESCAPES = (*_ESCAPES, ("]", "&#93;"), ("\n", "&#10;"))
_TURN = pa.struct([(n, pa.string() if n == "role" else pa.int64()) for n in ("role", "start", "end", "text_start", "text_end")])


def escape(text: str) -> str:
    """Make control strings harmless; ``unescape`` gives the text back."""
    for plain, code in _ESCAPES:
        text = text.replace(plain, code)
    return text


def unescape(text: str) -> str:
    for plain, code in reversed(_ROLE_ESCAPES):
        text = text.replace(code, plain)
    return text


def marked_turns(turns: list[tuple[str, str]], prompt_role: str | None = None) -> str:
    """The built-in template: ``<s>[role]``, a new line, the text, ``</s>`` and a new line for each turn.

    Escaped texts hold no ``<`` or ``[``, so no text can pass for a control string such as ``</s>`` or ``[INST]``.
    """

    def head(role: str) -> str:
        for plain, code in _ROLE_ESCAPES:
            role = role.replace(plain, code)
        return f"<s>[{role}]\n"

    out = "".join(f"{head(role)}{escape(text)}</s>\n" for role, text in turns)
    return out if prompt_role is None else out + head(prompt_role)


class HistoryRewritten(ValueError):
    """A template changed what it had rendered for earlier turns; ``turn`` is the first one that did."""

    def __init__(self, turn: int):
        super().__init__(f"turn {turn} changes the text of earlier turns")
        self.turn = turn


def locate(turns: list[tuple[str, str]], render: Render, context: int | None) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Render a conversation and find (start, end, text start, text end) of each turn, in code points.

    The prefixes with and without a turn are rendered and compared; the same turn without text and the prompt of its role tell
    where its text begins and ends. Without ``context`` every prefix is rendered in full, in time quadratic in the turns. With it only so
    many turns before each are rendered along, in linear time, which is for templates known to look no further back: the whole
    rendering must then equal the pieces, else all prefixes are rendered in full, but rewriting that the whole undoes is not seen.
    Raises HistoryRewritten if a prefix does not begin as the one before it.
    """
    spans, pieces, at = [], [], 0
    whole = render([], None)
    for i, (role, text) in enumerate(turns):
        before = turns[: i] if context is None else turns[max(0, i - context) : i]
        base = whole if context is None else render(before, None)
        full = whole = render([*before, (role, text)], None)
        head, empty = render(before, role), render([*before, (role, "")], None)
        if not (full.startswith(base) and head.startswith(base) and empty.startswith(base)):
            if context is None:
                raise HistoryRewritten(i)
            return locate(turns, render, None)
        size, first = len(full) - len(base), len(head) - len(base)
        if context is not None:
            pieces.append(full[len(base) :])
        spans.append((at, at + size, at + first, at + first + len(full) - len(empty)))
        at += size
    if context is not None:
        whole = render(turns, None)
        if "".join(pieces) != whole:
            return locate(turns, render, None)
    return whole, spans


def format_chat(df: DataFrame, render: Render = marked_turns, context: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col, formatted, turns, loss, rewritten_at``.

    Turns are ordered by their number, then role and text; repeated rows are turns of their own. Null texts and roles count as
    empty, a null turn number comes first, rows with a null conversation id form one conversation. ``turns`` has for each turn its
    role and the code points of the turn and of its text in ``formatted``; ``loss`` are the text spans of ``loss_role``.
    If the template rewrites history, ``rewritten_at`` is the first turn that does and there are no spans. ``context`` says how
    many earlier turns a turn's rendering may depend on (None: any number, all prefixes are rendered and compared). An empty table gives an
    empty result; other columns are not read. A conversation's rows are gathered in lists before the shuffle, so one of many
    turns is as many rows as tasks that hold some of it; it must fit a task, as its formatted text does.
    """
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    talks = df.groupBy(F.col(conv_col).cast("bigint").alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_kind, loss_kind = pa.list_(_TURN), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names = [conv_col, "formatted", "turns", "loss", "rewritten_at"]
        kinds = [pa.int64(), pa.string(), spans_kind, loss_kind, pa.int64()]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

        out, size = [], 0
        for batch in batches:
            for k, conv in enumerate(batch.column("conv").to_pylist()):
                turns = [(t["role"], t["text"]) for t in batch.column("turns")[k].as_py()]
                spans, wrong = [], None
                try:
                    formatted, places = locate(turns, render, context)
                    spans = [{"role": role, "start": a, "end": b, "text_start": c, "text_end": d} for (role, _), (a, b, c, d) in zip(turns, places, strict=True)]
                except HistoryRewritten as e:
                    formatted, wrong = render(turns, None), e.turn
                loss = [{"start": s["text_start"], "end": s["text_end"]} for s in spans if s["role"] == loss_role]
                out.append((conv, formatted, spans, loss, wrong))
                size += len(formatted)
                if size > 1 << 20 or len(out) == 1000:
                    yield rows(out)
                    out, size = [], 0
        if out:
            yield rows(out)

    kind = "array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint>>"
    return talks.mapInArrow(run, f"`{conv_col}` bigint, formatted string, turns {kind}, loss array<struct<start:bigint,end:bigint>>, rewritten_at bigint")


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the built-in template's output says: ``conv_col, n_turns, said, learnt, formatted_chars``.

    Everything is taken from ``formatted`` by the spans: ``said`` is role, new line, text, new line of each turn, ``learnt`` the
    unescaped text under the loss mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, said, learnt, size = [], [], [], []
            for formatted, turns, loss in zip(*(batch.column(c).to_pylist() for c in ("formatted", "turns", "loss")), strict=True):
                roles = [formatted[t["start"] : t["text_start"]][len("<s>[") : -len("]\n")] for t in turns]
                texts = [formatted[t["text_start"] : t["text_end"]] for t in turns]
                count.append(len(turns))
                said.append("".join(f"{unescape(r)}\n{unescape(t)}\n" for r, t in zip(roles, texts, strict=True)))
                learnt.append("".join(unescape(formatted[s["start"] : s["end"]]) for s in loss))
                size.append(len(formatted))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(count, pa.int64()), pa.array(said), pa.array(learnt), pa.array(size, pa.int64())], names=[conv_col, "n_turns", "said", "learnt", "formatted_chars"])

    source = chats.select(F.col(conv_col).alias("conv"), "formatted", "turns", "loss")
    return source.mapInArrow(run, f"`{conv_col}` bigint, n_turns bigint, said string, learnt string, formatted_chars bigint")
