"""Chat formatting with a declarative template and a finite-state machine over roles.

Each turn becomes three segments: the role's opening mark, the escaped text, the closing mark. Only texts of
roles that the template marks for loss carry the flag. Control strings inside texts get an escape character in front, and
so does the escape character, which is undone exactly on reading. Turns stream through a task in order, so
a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks per role, roles whose text is learnt, permitted successions, and states a conversation may end in."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")  # any other role: its name stands between the first two
    learnt: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})
    escape: str = "\\"

    @cached_property
    def controls(self) -> re.Pattern:
        strings = {m.strip() for pair in self.marks.values() for m in pair} | set(self.other)
        return re.compile("|".join(map(re.escape, [self.escape, *sorted(strings, key=len, reverse=True)])))

    def protect(self, text: str) -> str:
        return self.controls.sub(lambda m: self.escape + m[0], text)

    def reveal(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + self.controls.pattern + ")", lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.protect(role) + self.other[1], self.other[2]
        return [(before, False), (self.protect(text), role in self.learnt), (after, False)]

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, (before, after) in self.marks.items():
            if turn.startswith(before) and turn.endswith(after):
                return role, self.reveal(turn[len(before):len(turn) - len(after)])
        opening, says, closing = self.other
        if not (turn.startswith(opening) and turn.endswith(closing)):
            raise ValueError("not a formatted turn")
        body, at = turn[len(opening):len(turn) - len(closing)], 0
        for m in re.finditer(re.escape(self.escape) + f"(?:{self.controls.pattern})|{re.escape(says)}", body):
            if m[0] == says:
                at = m.start()
                break
        return self.reveal(body[:at]), self.reveal(body[at + len(says):])

    def next_state(self, state: str | None, role: str) -> str | None:
        """The machine's state after a turn; None once an order was broken."""
        return role if state is not None and role in self.moves.get(state, ()) else None


def _ordered(turns: DataFrame, *order: str) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = Template()) -> DataFrame:
    """One row per turn: ``conv_id``, its number ``n``, ``segments`` array<struct<text, loss>>, and ``valid`` so far.

    Turns go by ``turn`` (nulls first), equal ones by role and text; repeated rows are turns of their own. A null
    role is the empty one, a null text the empty text. A null conversation id is one conversation. ``valid`` is
    false from the first turn that the machine refuses; all turns are formatted. Further columns are not read.
    """
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    segment = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, state = object(), 0, ""
        for batch in batches:
            out, numbers, valid = [], [], []
            for key, who, what in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if key != at:
                    at, n, state = key, 0, ""
                state = template.next_state(state, who)
                out.append([{"text": t, "loss": loss} for t, loss in template.segments(who, what)])
                numbers.append(n)
                valid.append(state is not None)
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(numbers, pa.int64()), pa.array(out, segment), pa.array(valid, pa.bool_())], ["conv_id", "n", "segments", "valid"])

    return _ordered(rows, "turn", "role", "text").mapInArrow(run, f"conv_id {kind}, n bigint, segments array<struct<text:string,loss:boolean>>, valid boolean")


def read_turns(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n, role, text, learnt, chars, valid) parsed from formatted turns; ``learnt`` is the unescaped text under the loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts, learnt, chars = [], [], [], []
            for parts in batch.column("segments").to_pylist():
                turn = "".join(p["text"] for p in parts)
                role, text = template.parse(turn)
                roles.append(role)
                texts.append(text)
                learnt.append(template.reveal("".join(p["text"] for p in parts if p["loss"])))
                chars.append(len(turn))
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), batch.column("n"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(learnt, pa.string()), pa.array(chars, pa.int64()), batch.column("valid")],
                ["conv_id", "n", "role", "text", "learnt", "chars", "valid"])

    return formatted.mapInArrow(run, f"conv_id {kind}, n bigint, role string, text string, learnt string, chars bigint, valid boolean")


def digests(read: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation: turns and their digest, learnt text and its digest, formatted characters, and whether its order is valid."""
    kind = read.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, at = None, object()

        def close() -> pa.RecordBatch:
            key, n, turns, chars, loss, total, valid, role = open_
            row = [n, turns.hexdigest(), chars, loss.hexdigest(), total, valid and role in template.ends]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([key, *(pa.array([v], k) for v, k in zip(row, kinds))], names)

        for batch in batches:
            done = []
            for i, (key, role, text, learnt, chars, valid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learnt", "chars", "valid")))):
                if key != at:
                    if open_ is not None:
                        done.append(close())
                    at, open_ = key, [batch.column("conv_id").slice(i, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                open_[3] += len(learnt)
                open_[4].update(learnt.encode())
                open_[5] += chars
                open_[6], open_[7] = valid, role
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if open_ is not None:
            yield close()

    ordered = _ordered(read, "n")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
