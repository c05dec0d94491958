"""Conversations as training text: a declarative template, a state machine over roles, a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import Batches, batch, mapped, slices

Segment = tuple[str, bool]

_FORMATTED = "conv_id long, formatted string, loss_start array<long>, loss_length array<long>, " \
             "valid boolean"
_TURNS = "conv_id long, roles array<string>, texts array<string>, loss_text string, formatted_chars long"


def _default_marks() -> dict[str, tuple[str, str]]:
    return {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST]", "[/INST]"),
            "assistant": ("<|reply|>", "</s>")}


def _default_order() -> dict[str, tuple[str, ...]]:
    return {"start": ("system", "user"), "system": ("user",), "user": ("assistant",),
            "assistant": ("user",)}


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are marked, which roles are learned, and in which order roles may come.

    `marks`: what stands before and after a turn of a role; `other`: around the name of a role that
    has no marks, and `other_end` after its text. Every mark begins with one of the `special`
    characters; inside texts these and the escape character get an escape character in front, so
    no text looks like a mark and every text can be restored. `order`: the roles that may follow
    each state, from "start"; a conversation may end in a state of `final`.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=_default_marks)
    other: tuple[str, str] = ("<|role|>", "<|text|>")
    other_end: str = "<|end|>"
    learned: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(default_factory=_default_order)
    final: tuple[str, ...] = ("user", "assistant")
    escape: str = "\\"
    special: str = "<["

    def __post_init__(self):
        opening = [first for first, _ in self.marks.values()] + [self.other[0]]
        for mark in [m for pair in self.marks.values() for m in pair] + [*self.other, self.other_end]:
            if not mark or mark[0] not in self.special or self.escape in mark:
                raise ValueError(f"a mark must begin with one of {self.special!r}: {mark!r}")
        if any(a != b and b.startswith(a) for a in opening for b in opening):
            raise ValueError("no opening mark may begin with another one")

    def hide(self, text: str) -> str:
        return re.sub(f"[{re.escape(self.escape + self.special)}]",
                      lambda m: self.escape + m[0], text)

    def show(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", text, flags=re.DOTALL)

    def step(self, state: str, role: str) -> str:
        """The state after a turn: its role, or "error", which no turn leaves."""
        return role if role in self.order.get(state, ()) else "error"

    def segments(self, turns: list[tuple[str, str]]) -> Iterator[Segment]:
        for role, text in turns:
            if role in self.marks:
                first, last = self.marks[role]
            else:
                first, last = self.other[0] + self.hide(role) + self.other[1], self.other_end
            yield first, False
            yield self.hide(text), role in self.learned
            yield last, False

    def valid(self, turns: list[tuple[str, str]]) -> bool:
        state = "start"
        for role, _ in turns:
            state = self.step(state, role)
        return state in self.final

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text; ValueError if it is none."""
        plain = re.compile(f"(?:[^{re.escape(self.escape + self.special)}]+"
                           f"|{re.escape(self.escape)}.)*", re.DOTALL)
        at, turns = 0, []

        def text() -> str:
            nonlocal at
            found = plain.match(formatted, at)
            at = found.end()
            return self.show(found[0])

        def mark(*marks: str) -> str:
            nonlocal at
            found = next((m for m in marks if formatted.startswith(m, at)), None)
            if found is None:
                raise ValueError(f"no mark at {at}")
            at += len(found)
            return found

        roles = {first: role for role, (first, _) in self.marks.items()}
        while at < len(formatted):
            role = roles.get(mark(*roles, self.other[0]))
            if role is None:
                role = text()
                mark(self.other[1])
                turns.append((role, text()))
                mark(self.other_end)
            else:
                turns.append((role, text()))
                mark(self.marks[role][1])
        return turns


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_start, loss_length (spans), valid.

    `turns` has conv_id, turn, role and text; rows are ordered by turn (null first), then role and
    text. The state machine of the template emits each turn as opening mark, escaped text and
    closing mark; only the text of learned roles is under the loss mask, whose spans count code
    points. `valid`: the roles came in an order the template allows; others are formatted as well.

    Null texts and roles count as empty. Rows with a null conv_id are one conversation. Repeated rows
    are turns like others. An empty table gives an empty one. Other columns are not read.

    A conversation is one value, so its turns meet in one row; long ones bound a task's memory.
    """
    template = template or ChatTemplate()
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()),
                        ("loss_start", pa.list_(pa.int64())), ("loss_length", pa.list_(pa.int64())),
                        ("valid", pa.bool_())])
    row = F.struct(F.col("turn").cast("long").alias("turn"),
                   F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
             .select("conv_id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts")))

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            out = []
            for roles, texts in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                rows = list(zip(roles, texts))
                at, parts, starts, lengths = 0, [], [], []
                for text, loss in template.segments(rows):
                    parts.append(text)
                    if loss:
                        starts.append(at)
                        lengths.append(len(text))
                    at += len(text)
                out.append(("".join(parts), starts, lengths, template.valid(rows)))
            yield batch(schema, some.column(0), *(list(column) for column in zip(*out)))

    return mapped(chats, task, _FORMATTED)


def read_conversations(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """conv_id, roles and texts parsed from `formatted`, loss_text (all text under the mask,
    unescaped, in order) and formatted_chars (code points)."""
    template = template or ChatTemplate()
    schema = pa.schema([("conv_id", pa.int64()), ("roles", pa.list_(pa.string())),
                        ("texts", pa.list_(pa.string())), ("loss_text", pa.string()),
                        ("formatted_chars", pa.int64())])

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            out = []
            for text, starts, lengths in zip(*(some.column(i).to_pylist() for i in (1, 2, 3))):
                turns = template.parse(text)
                learned = [template.show(text[a:a + n]) for a, n in zip(starts, lengths)]
                out.append(([r for r, _ in turns], [t for _, t in turns], "".join(learned), len(text)))
            yield batch(schema, some.column(0), *(list(column) for column in zip(*out)))

    read = formatted.select("conv_id", "formatted", "loss_start", "loss_length")
    return mapped(read, task, _TURNS)
