"""Chat formatting in budgeted windows, with a loss mask.

A turn is written as

    ### role:
    text</turn>

where a backslash goes before every backslash, ``#``, ``<``, ``/`` and ``:`` of a role, and in a text before every backslash,
every ``#`` of a run of three or more, and the slash of every ``</turn>``. So the strings ``###`` and ``</turn>`` stand nowhere
but where the template puts them, and parsing gives each role and text back.

A conversation is cut at turns into windows by prefix sums of its turns' tokens, searched by bisection: the system turn (if
the first turn is one), then as many of the last turns before as fit the history budget, then as many new turns as fit the
rest, one at least. Each turn is new in exactly one window. What is repeated gives way to the first new turn: history
first, then the system turn. So a window is over the budget only if it is a single turn that is, whole; a system turn over
the budget is such a window, and no other has it. The loss mask has the spans of the texts of new assistant turns: repeated
ones are masked.

Rows are dealt by conversation and sorted by turn, then stream by: a task holds the turns of a window and its history,
never a conversation.

Defined results: a null text or role is empty; turns of equal number go by role, then text, and rows that repeat are all
formatted; null conversation ids form one conversation, and null turn numbers come first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPED_TEXT = re.compile(r"\\|#{3,}|(?<=<)/(?=turn>)")
ESCAPED_ROLE = re.compile(r"[\\#</:]")
UNESCAPED = re.compile(r"\\([\\#</:])")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+):\n((?:[^<]|<(?!/turn>))*+)</turn>\n", re.DOTALL)
END = "</turn>\n"


def escape(text: str, pattern: re.Pattern = ESCAPED_TEXT) -> str:
    return pattern.sub(lambda m: "\\#" * len(m[0]) if m[0][0] == "#" else f"\\{m[0]}", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


@dataclass
class Turn:
    role: str
    head: str
    body: str
    tokens: int

    @property
    def text(self) -> str:
        return f"{self.head}{self.body}{END}"


@dataclass
class Window:
    """repeated: turns at the start that are new in an earlier window. spans: [start, end) in code points."""

    number: int
    repeated: int
    turns: list[Turn]

    def row(self) -> tuple[str, list[tuple[int, int]], int, int]:
        out, spans, at = [], [], 0
        for i, t in enumerate(self.turns):
            if i >= self.repeated and t.role == "assistant":
                spans.append((at + len(t.head), at + len(t.head) + len(t.body)))
            out.append(t.text)
            at += len(t.text)
        return "".join(out), spans, len(self.turns), self.repeated


def count_words(text: str) -> int:
    """Tokens of a text where no tokenizer is given: its words, one for the mark."""
    return len(text.encode("utf-8", "replace").split()) + 1


def windows(turns: Iterator[tuple[str | None, str | None]], budget: int, history: int, count: Callable[[str], int] = count_words) -> Iterator[Window]:
    """The windows of the turns (role, text) of one conversation. A turn counts as one token at least."""
    held: list[Turn] = []  # turns that a window can still hold
    before = [0]  # tokens of the conversation before each of them, and after the last
    at, first, number = 0, 0, 0  # the next new turn, the first that history may repeat, the window
    system: Turn | None = None

    def read() -> bool:
        role, text = next(turns, (None, None))
        if role is None and text is None:
            return False
        head, body = f"### {escape(role, ESCAPED_ROLE)}:\n", escape(text)
        held.append(Turn(role, head, body, max(1, count(f"{head}{body}{END}"))))
        before.append(before[-1] + held[-1].tokens)
        return True

    turns = ((role or "", text or "") for role, text in turns)
    while at < len(held) or read():
        new = held[at].tokens
        if number == 0 and held[at].role == "system":
            system, first = held[at], 1
        start = [system] if system is not None and number > 0 and system.tokens + new <= budget else []
        room = budget - sum(t.tokens for t in start)
        again = bisect_left(before, before[at] - max(0, min(history, room - new)), min(first, at), at)
        while before[-1] - before[again] <= room and read():
            pass
        end = max(at + 1, bisect_right(before, before[again] + room) - 1)
        yield Window(number, len(start) + at - again, [*start, *held[again:end]])
        gone = bisect_left(before, before[end] - history, 0, end)
        del held[:gone], before[:gone]
        at, first, number = end - gone, max(0, first - gone), number + 1


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted window. Raises ValueError if it isn't one."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else bytes(value).decode("utf-8", "replace")


def format_chat(conversations: DataFrame, *, budget: int = 512, history: int = 96, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", count: Callable[[str], int] = count_words) -> DataFrame:
    """conv_col, window, text, spans (of the loss, in code points), n_turns and n_repeated of each window.

    budget: tokens of a window. history: tokens of it at most for repeated turns besides the system turn. count: tokens
    of a formatted turn; words by default.
    """
    schema = pa.schema([("conv", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_turns", pa.int32()), ("n_repeated", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), map(_text, batch.column(1).to_pylist()), map(_text, batch.column(2).to_pylist()), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, own in groupby(rows(batches), key=lambda r: r[0]):
            for w in windows(((r[1], r[2]) for r in own), budget, history, count):
                text, spans, n, repeated = w.row()
                out.append((conv, w.number, text, [{"start": a, "end": b} for a, b in spans], n, repeated))
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    c = conversations
    lean = c.select(c[conv_col].cast("long").alias("_conv"), c[turn_col].alias("_turn"), F.coalesce(c[role_col].cast("string"), F.lit("")).cast("binary").alias("_role"), F.coalesce(c[text_col].cast("string"), F.lit("")).cast("binary").alias("_text"))
    dealt = lean.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").select("_conv", "_role", "_text")
    return dealt.mapInArrow(run, "conv long, window int, text string, spans array<struct<start:int,end:int>>, n_turns int, n_repeated int").withColumnRenamed("conv", conv_col)


def digest_chat(formatted: DataFrame, *, conv_col: str = "conv_id", dealt: bool = False) -> DataFrame:
    """What the windows of each conversation say, read back from their texts and spans, in one pass over sorted rows.

    conv_col, n_turns, turns_sha256 (of role, newline, text, newline of each turn), loss_chars and loss_sha256 (of the
    texts under the loss mask), and formatted_chars. dealt: the windows of a conversation follow each other in one
    partition, as in what format_chat returns, so no shuffle is needed.
    """
    schema = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = (r for b in batches for r in b.to_pylist())
        for conv, own in groupby(rows, key=lambda r: r["conv"]):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for w in own:
                for role, text in parse(w["text"])[w["n_repeated"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in w["spans"]:
                    text = unescape(w["text"][s["start"] : s["end"]])
                    loss.update(text.encode())
                    loss_chars += len(text)
                chars += len(w["text"])
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    lean = formatted.select(formatted[conv_col].alias("conv"), "window", "text", "spans", "n_repeated")
    lean = lean if dealt else lean.repartition("conv").sortWithinPartitions("conv", "window")
    return lean.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)
