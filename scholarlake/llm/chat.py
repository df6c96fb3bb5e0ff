"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads the turns of a conversation in order. Its output is a stream of text segments, each with a
loss flag. Conversations are sorted within partitions and read row by row, so one of any length needs the
memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn's text, which roles are learned, and which role may follow which."""

    before: dict[str, str]
    after: dict[str, str]
    loss: frozenset[str]
    follows: dict[str, frozenset[str]]
    #: Of any other role: its name stands between the first two.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        found = {*self.before.values(), *self.after.values(), *self.other} - {""}
        if any(c[0] in d[1:] and d != c and any(d.endswith(c[:n]) for n in range(1, len(c))) for c in found for d in found):
            raise ValueError("control strings may not overlap")
        object.__setattr__(self, "controls", tuple(sorted(found, key=lambda c: (-len(c), c))))

    def armour(self) -> re.Pattern:
        """A control string, perhaps already escaped: its first character, escapes, and the rest."""
        e = re.escape(self.escape)
        return re.compile("|".join(rf"(?<={re.escape(c[0])}){e}*(?={re.escape(c[1:])})" for c in self.controls))


TEMPLATE = Template(
    before={"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"},
    after={"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"},
    loss=frozenset({"assistant"}),
    follows={"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})},
)
SEGMENTS = "conv_id {kind}, turn long, part int, text string, loss boolean, valid boolean"


def escaped(text: str, t: Template, armour: re.Pattern) -> str:
    """One more escape inside every control string, escaped before or not: nothing in the result reads as control."""
    return armour.sub(lambda m: t.escape + m[0], text) if any(c[0] in text for c in t.controls) else text


def unescaped(text: str, t: Template, armour: re.Pattern) -> str:
    return armour.sub(lambda m: m[0][len(t.escape) :], text) if t.escape in text else text


def format_conversations(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Text segments of all conversations: (conv_id, turn, part, text, loss, valid), in order within partitions.

    `turns` has conv_id, turn, role, text; other columns are ignored. Parts 0, 1, 2 of a turn are what stands
    before its text, its escaped text, and what stands after. Null texts and roles are empty; turns without a
    number come first; rows of the same turn follow in order of role and text, each a turn of its own, and
    repeated rows stay. `valid` tells whether the machine allows the turn after the ones before it; a turn that
    breaks the order is formatted all the same, and the machine goes on from its role.
    """
    kind = dict(turns.dtypes)["conv_id"]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    t = template

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        armour, last, state = t.armour(), (), ""
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if (conv,) != last:
                    last, state = (conv,), ""
                ok = role in t.follows.get(state, ())
                state = role
                if role in t.before:
                    before, after = t.before[role], t.after[role]
                else:
                    before, after = t.other[0] + escaped(role, t, armour) + t.other[1], t.other[2]
                out += [(conv, turn, 0, before, False, ok), (conv, turn, 1, escaped(text, t, armour), role in t.loss, ok), (conv, turn, 2, after, False, ok)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["conv_id", "turn", "part", "text", "loss", "valid"])

    return rows.mapInArrow(each, SEGMENTS.format(kind=kind))


class Reader:
    """Reads formatted text back, a piece at a time: turns of role and text, hashed as they pass."""

    def __init__(self, t: Template):
        self.t, self.armour = t, t.armour()
        self.control = re.compile("|".join(map(re.escape, t.controls)))
        self.starts = {b: r for r, b in t.before.items()}
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.role: str | None = None
        self.kept: list[str] = []

    def read(self, piece: str, loss: bool) -> None:
        self.chars += len(piece)
        at = 0
        for m in self.control.finditer(piece):
            self._text(piece[at : m.start()])
            self._control(m[0])
            at = m.end()
        self._text(piece[at:])
        if loss:
            plain = unescaped(piece, self.t, self.armour)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "replace"))

    def _text(self, piece: str) -> None:
        if piece:
            self.kept.append(piece)

    def _control(self, c: str) -> None:
        said, self.kept = unescaped("".join(self.kept), self.t, self.armour), []
        if c in self.starts:
            self.role = self.starts[c]
        elif c == self.t.other[1]:
            self.role = said
        elif c != self.t.other[0]:
            self.n_turns += 1
            self.turns.update(f"{self.role}\n{said}\n".encode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the formatted text of each conversation says: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid).

    `segments` come as format_conversations gives them: a conversation in one partition, in order.
    """
    kind = dict(segments.dtypes)["conv_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader, valid = (), None, True
        for batch in batches:
            out = []
            for conv, text, loss, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if (conv,) != last:
                    if reader:
                        out.append((*last, *reader.row(), valid))
                    last, reader, valid = (conv,), Reader(template), True
                reader.read(text, loss)
                valid &= ok
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            if out:
                yield _rows(out, types)
        if reader:
            yield _rows([(*last, *reader.row(), valid)], types)

    return segments.mapInArrow(each, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _rows(rows: list[tuple], types: tuple) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)
