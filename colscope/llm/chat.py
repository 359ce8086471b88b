"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

A template names control strings around each role's text.  Wherever one of them, or the escape character, stands in a
text, it is escaped, so the formatted conversation reads back exactly.  Turns stream in order through their task and
only the machine's state is kept between them, so a conversation may be longer than memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, on_workers

START, OTHER = "start", "other"


@dataclass(frozen=True)
class Template:
    """Control strings before and after each role's text, and the roles that carry loss.

    A role that is not listed is written as ``other``, with its name in front of the text.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"),
        OTHER: ("[ROLE]", "[/ROLE]")})
    loss: tuple[str, ...] = ("assistant",)
    pad: str = " "
    escape: str = "\\"
    # Which roles may follow which; a conversation must end after a role in ``last``.
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair}, key=len, reverse=True)


class Codec:
    """Escapes texts, and reads formatted text back."""

    def __init__(self, template: Template):
        self.t = template
        controls = [re.escape(c) for c in template.controls()]
        e = re.escape(template.escape)
        self.special = re.compile("|".join([e, *controls]))
        self.token = re.compile("|".join([f"{e}.", *controls]), re.DOTALL)
        self.opening = {before: role for role, (before, _) in template.marks.items()}

    def escaped(self, text: str) -> str:
        """The escape character goes in front of itself and of every control string."""
        return self.special.sub(lambda m: self.t.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        e = re.escape(self.t.escape)
        return re.sub(f"{e}(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of the three segments of a turn."""
        kind = role if role in self.t.marks and role != OTHER else OTHER
        before, after = self.t.marks[kind]
        name = self.escaped(role) + "\n" if kind == OTHER else ""
        return [(before + self.t.pad + name, False), (self.escaped(text), role in self.t.loss), (self.t.pad + after, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn in formatted text."""
        turns, start, role = [], 0, None
        for m in self.token.finditer(formatted):
            if m[0].startswith(self.t.escape):
                continue
            if role is None:
                role, start = self.opening[m[0]], m.end() + len(self.t.pad)
            elif m[0] == self.t.marks[role][1]:
                body = formatted[start:m.start() - len(self.t.pad)]
                if role == OTHER:
                    name, _, body = body.partition("\n")
                    role = self.unescaped(name)
                turns.append((role, self.unescaped(body)))
                role = None
            else:
                raise ValueError(f"{m[0]} inside a turn of {role}")
        return turns


SEGMENT = "turn long, segment int, role string, text string, loss boolean, in_order boolean"


def format_chat(rows: DataFrame, template: Template | None = None, id: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """(id, turn, segment, role, text, loss, in_order): the segments of all conversations, numbered from 0 in each.

    Turns are taken in order of turn (null first), role and text; in_order says whether the machine allows the turn's
    role where it stands, and out of order turns are formatted all the same.  A null role or text is empty, rows with
    a null id are one conversation, repeated rows are turns of their own, other columns are not looked at, and no rows
    give no segments.  A conversation is read by one task as a stream, its sort spills.
    """
    template = template or Template()
    kind = rows.schema[id].dataType
    schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string(SEGMENT).fields])

    def run(batches: Iterator[pa.RecordBatch]):
        codec, at, state, number = Codec(template), object(), START, 0
        for batch in batches:
            out: list[tuple] = []
            for own, n, r, t in zip(*[c.to_pylist() for c in batch.columns]):
                if own != at:
                    at, state, number = own, START, 0
                allowed = r in template.turns.get(state, ())
                state = r
                for segment, loss in codec.segments(r, t):
                    out.append((own, n, number, r, segment, loss, allowed))
                    number += 1
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), *[pa.array(v, k) for v, k in zip(columns[1:], _KINDS)]],
                schema.names)

    clean = rows.select(named(id).alias("id"), named(turn).cast("long").alias("turn"),
                        *[F.coalesce(named(c).cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    ordered = clean.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return on_workers(ordered).mapInArrow(run, schema).withColumnRenamed("id", id)


_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
DIGEST = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_system long, "
          "well_formed boolean")


def read_back(segments: DataFrame, template: Template | None = None, id: str = "conv_id") -> DataFrame:
    """Per conversation, what its segments say: turns and loss text, read from the formatted text and unescaped.

    The segments of a turn are joined and parsed by their control strings; their role column is not used.
    ``well_formed`` is whether every turn was in order and the last role may end a conversation.
    """
    template = template or Template()
    kind = segments.schema[id].dataType
    schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string(DIGEST).fields])

    def run(batches: Iterator[pa.RecordBatch]):
        codec, own, pending, stats = Codec(template), None, "", None
        done: list[list] = []
        for batch in batches:
            for i, number, text, loss, allowed in zip(*[c.to_pylist() for c in batch.columns]):
                if number == 0:
                    if stats:
                        done.append(_digest(own, stats))
                    own, pending, stats = i, "", _Stats()
                stats.chars += len(text)
                stats.well &= allowed
                if loss:
                    plain = codec.unescaped(text)
                    stats.loss_chars += len(plain)
                    stats.loss.update(plain.encode())
                pending += text
                if number % 3 == 2:
                    for role, plain in codec.read(pending):
                        stats.turns.update(f"{role}\n{plain}\n".encode())
                        stats.n += 1
                        stats.system += role == "system"
                        stats.last = role
                    pending = ""
            if done:
                yield _digests(done, batch.schema.field(0).type, schema.names, template)
                done = []
        if stats:
            yield _digests([_digest(own, stats)], batch.schema.field(0).type, schema.names, template)

    ordered = segments.select(named(id).alias("id"), "segment", "text", "loss", "in_order").repartition("id")
    ordered = ordered.sortWithinPartitions("id", "segment")
    return on_workers(ordered).mapInArrow(run, schema).withColumnRenamed("id", id)


class _Stats:
    def __init__(self):
        self.n = self.chars = self.loss_chars = self.system = 0
        self.well, self.last = True, START
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()


def _digest(own, s: _Stats) -> list:
    return [own, s.n, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars, s.system, (s.well, s.last)]


def _digests(done: list[list], kind: pa.DataType, names: list[str], template: Template) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*done)]
    columns[-1] = [well and last in template.last for well, last in columns[-1]]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names)
