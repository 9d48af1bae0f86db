"""Chat formatting: a finite-state machine over roles, and a declarative template that can be read back.

The machine's state is the role of the last turn (START before the first). A template has a pattern for each allowed
step from a state to a role, which is at once the check of turn order and the layout; a turn that no step allows is laid
out by the pattern for others, which names its role, and marked invalid. Every pattern gives text segments, of which those
holding a trained role's text count for the loss.

Patterns are made of marks (control strings), padding and the slots {text} and {role}. What fills a slot has an escape
character put behind the first character of everything that is a mark, or a mark escaped before; taking one out again
gives the text back. So no text can open or end a turn, and texts without marks stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import ordered_by_key, slices, whole

START = "start"
BATCH_ROWS = 500
SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Pair:
    """What comes before a mark of a pattern: padding around a slot or, without a slot, nothing."""

    before: str
    slot: str | None
    after: str
    mark: str


class Template:
    """steps: (state, role, pattern); other: the pattern of turns that no step allows.

    Marks must be such that every text can be read back: none holds the escape character, none has the first character of
    any mark within, none begins another; every pattern ends in a mark, and no pattern's marks begin another's.
    """

    def __init__(self, marks: Iterable[str], steps: Iterable[tuple[str, str, str]], other: str, trained: Iterable[str] = ("assistant",), final: Iterable[str] = ("assistant",), escape: str = "\\"):
        self.marks, self.escape, self.trained, self.final = tuple(marks), escape, frozenset(trained), frozenset(final)
        heads = {m[:1] for m in self.marks}
        for m in self.marks:
            if len(m) < 2 or escape in m or not heads.isdisjoint(m[1:]) or any(o != m and o.startswith(m) for o in self.marks):
                raise ValueError(f"mark {m!r} cannot be told apart")
        self.mark = re.compile("|".join(map(re.escape, self.marks)))
        sites = [(re.escape(h), f"(?={re.escape(escape)}*(?:{'|'.join(re.escape(m[1:]) for m in self.marks if m[0] == h)}))") for h in sorted(heads)]
        self._put = re.compile("|".join(f"(?<={h}){rest}" for h, rest in sites))
        self._take = re.compile("|".join(f"(?<={h}){re.escape(escape)}{rest}" for h, rest in sites))
        self.steps = {(state, role): self._pairs(pattern) for state, role, pattern in steps}
        self.other = self._pairs(other)
        self.roles = frozenset(role for _, role in self.steps)
        self.shapes: dict[tuple[str, ...], tuple[str | None, list[Pair]]] = {}
        for role, pairs in [*((role, pairs) for (_, role), pairs in self.steps.items()), (None, self.other)]:
            known = self.shapes.setdefault(tuple(p.mark for p in pairs), (role, pairs))
            if known != (role, pairs):
                raise ValueError(f"{known[0]} and {role} turns have the same marks")
        if any(a != b and b[: len(a)] == a for a in self.shapes for b in self.shapes):
            raise ValueError("one pattern's marks begin another's")

    def _pairs(self, pattern: str) -> list[Pair]:
        found, at = [], 0
        for m in self.mark.finditer(pattern):
            before, slot, after = re.fullmatch(r"([^{}]*)(?:\{(text|role)\}([^{}]*))?", pattern[at : m.start()]).groups()
            if before and not slot:
                raise ValueError(f"padding without a slot in {pattern!r}")
            found.append(Pair(before, slot, after or "", m[0]))
            at = m.end()
        if at != len(pattern) or not any(p.slot == "text" for p in found):
            raise ValueError(f"{pattern!r} must hold {{text}} and end in a mark")
        return found

    def hide(self, text: str) -> str:
        """The text with every mark in it broken up."""
        return self._put.sub(lambda _: self.escape, text)

    def show(self, text: str) -> str:
        """What hide() was given."""
        return self._take.sub("", text)

    def lay_out(self, state: str, role: str, text: str) -> tuple[str, bool, list[tuple[str, bool]]]:
        """The next state, whether the step is allowed, and the turn's segments with their loss flags."""
        pairs = self.steps.get((state, role))
        said, plain = [], ""
        for p in pairs or self.other:
            plain += p.before
            if p.slot == "text":
                said += [(plain, False), (self.hide(text), role in self.trained)]
                plain = ""
            elif p.slot == "role":
                plain += self.hide(role)
            plain += p.after + p.mark
        said.append((plain, False))
        return (role if role in self.roles else START), pairs is not None, [s for s in said if s[0] or s[1]]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """role and text of each turn of formatted text; ValueError where it is not of this template."""
        pieces, marks, at = [], [], 0
        for m in self.mark.finditer(formatted):
            pieces.append(formatted[at : m.start()])
            marks.append(m[0])
            at = m.end()
        if at != len(formatted):
            raise ValueError("text after the last mark")
        turns, k = [], 0
        while k < len(marks):
            shape = next((s for s in self.shapes if tuple(marks[k : k + len(s)]) == s), None)
            if shape is None:
                raise ValueError(f"no turn begins with {marks[k]!r}")
            role, pairs = self.shapes[shape]
            held = {"role": role}
            for p, piece in zip(pairs, pieces[k : k + len(shape)]):
                inner = piece[len(p.before) : len(piece) - len(p.after)]
                if p.before + inner + p.after != piece or (inner and not p.slot):
                    raise ValueError(f"{piece!r} stands before {p.mark!r}")
                if p.slot:
                    held[p.slot] = self.show(inner)
            turns.append((held["role"], held["text"]))
            k += len(shape)
        return turns


#: Instructions in brackets, answers up to the end of the sequence. A system text may come first; then user and assistant alternate.
INST = Template(
    marks=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[SAYS]", "[/TURN]"),
    steps=(
        (START, "system", "<s>[SYS] {text} [/SYS]"),
        (START, "user", "<s>[INST] {text} [/INST]"),
        ("system", "user", "[INST] {text} [/INST]"),
        ("user", "assistant", " {text}</s>"),
        ("assistant", "user", "<s>[INST] {text} [/INST]"),
    ),
    other="[TURN]{role}[SAYS]{text}[/TURN]",
)
#: A header for each role.
HEADERS = Template(
    marks=("<|system|>", "<|user|>", "<|assistant|>", "<|other|>", "<|says|>", "<|end|>"),
    steps=tuple((state, role, f"<|{role}|>{{text}}<|end|>") for state, role in INST.steps),
    other="<|other|>{role}<|says|>{text}<|end|>",
)


def turns_in_order(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key, turn, role, text: each conversation in one partition, by turn (nulls first), then role and text; nulls as empty."""
    plain = rows.select(F.col(key).alias("key_"), F.col(turn).alias("turn_"), whole(F.col(role).cast("string")).alias("role_"), whole(F.col(text).cast("string")).alias("text_"))
    return ordered_by_key(plain, "key_", ["turn_", "role_", "text_"])


def _segments(said: list[list[tuple[str, bool]]]) -> pa.Array:
    ends = [0]
    for turn in said:
        ends.append(ends[-1] + len(turn))
    flat = [s for turn in said for s in turn]
    parts = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.bool_())], ["text", "loss"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)


def format_turns(rows: DataFrame, template: Template = INST, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, a conversation's rows together and in order: conv_id, turn, role, valid and segments.

    A conversation's formatted text is that of all its segments. Null roles and texts count as empty, null turns come
    first, turns of one number go by role, then text; a null key is a conversation; repeated rows are turns of their own;
    long texts stay whole; other columns are not read; an empty table gives no rows. A conversation passes through
    one task, but as a stream: what is held is a batch, however long it is.
    """

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), START
        for batch in slices(batches, BATCH_ROWS):
            valid, said = [], []
            for conv, who, what in zip(*(batch.column(n).to_pylist() for n in ("key_", "role_", "text_"))):
                if conv != now:
                    now, state = conv, START
                state, ok, segments = template.lay_out(state, who, what)
                valid.append(ok)
                said.append(segments)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key_", "turn_", "role_")), pa.array(valid, pa.bool_()), _segments(said)], ["conv_id", "turn", "role", "valid", "segments"])

    own = {n: rows.schema[n].dataType.simpleString() for n in (key, turn)}
    return turns_in_order(rows, key, turn, role, text).mapInArrow(lay_out, f"conv_id {own[key]}, turn {own[turn]}, role string, valid boolean, segments {SEGMENTS}")


def text_of(segments: Column) -> Column:
    """The formatted text of a turn."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


class Reading:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv):
        self.conv, self.n, self.size, self.loss_size, self.last, self.valid = conv, 0, 0, 0, START, True
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Template, segments: list[dict], valid: bool) -> None:
        formatted = "".join(s["text"] for s in segments)
        for role, text in template.read(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n, self.last = self.n + 1, role
        learnt = "".join(template.show(s["text"]) for s in segments if s["loss"])
        self.loss.update(learnt.encode("utf-8", "surrogatepass"))
        self.size, self.loss_size, self.valid = self.size + len(formatted), self.loss_size + len(learnt), self.valid and valid

    def row(self, template: Template) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_size, self.loss.hexdigest(), self.size, self.valid and self.last in template.final


READ = {"conv_id": None, "n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long", "valid": "boolean"}


def read_back(formatted: DataFrame, template: Template = INST) -> DataFrame:
    """One row per conversation of format_turns(): figures and digests of what its formatted text says when it is parsed.

    valid tells whether every turn was allowed after the one before and the last one is of a final role. formatted must
    come in the order that format_turns() gives; digests are made as the rows pass.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out(kind: pa.DataType) -> pa.RecordBatch:
            made = [pa.array(c, k) for c, k in zip(zip(*done), [kind, *kinds])]
            done.clear()
            return pa.RecordBatch.from_arrays(made, list(READ))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, valid, segments in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "valid", "segments"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row(template))
                    now = Reading(conv)
                now.add(template, segments, valid)
            if len(done) >= BATCH_ROWS:
                yield out(kind)
        if now is not None:
            done.append(now.row(template))
            yield out(kind)

    own = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "valid", "segments").mapInArrow(read, ", ".join(f"{n} {t or own}" for n, t in READ.items()))
