"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names each role's opening and closing control strings, which roles may follow which, and which roles' texts
bear loss. Formatting walks the turns, notes the first that the machine refuses, and emits text segments with loss flags.
Control strings inside texts get a backslash after their first character, and backslashes are doubled, so that parsing
the formatted text gives every turn back exactly.

Defined results: null text and null role count as empty; turns are ordered by number (null first), then role, then text,
and repeated rows are kept; a role that the template does not know is written with its name and bears no loss; a
conversation that the machine refuses is formatted all the same, with valid = false; rows of a null id form one
conversation; conversations of any length are formatted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_rows


@dataclass(frozen=True)
class Template:
    """roles: name -> (opening, closing, bears loss). follows: state -> roles allowed next. other: (opening, name's end, closing)."""

    roles: dict[str, tuple[str, str, bool]]
    follows: dict[str, tuple[str, ...]]
    other: tuple[str, str, str]
    start: str = "start"
    _control: list[str] = field(init=False)

    def __post_init__(self):
        strings = {s for opening, closing, _ in self.roles.values() for s in (opening, closing)} | set(self.other)
        object.__setattr__(self, "_control", sorted(strings, key=lambda s: (-len(s), s)))

    def pattern(self, more: str = "") -> re.Pattern:
        return re.compile("|".join([*([more] if more else []), *map(re.escape, self._control)]))

    def escape(self, text: str) -> str:
        return self.pattern(r"\\").sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def check(self, roles: list[str]) -> int | None:
        """The first turn that the machine refuses, or None."""
        state = self.start
        for i, role in enumerate(roles):
            if role not in self.follows.get(state, ()):
                return i
            state = role
        return None

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """(text, bears loss) in order; their concatenation is the formatted conversation."""
        out = []
        for role, text in turns:
            if role in self.roles:
                opening, closing, loss = self.roles[role]
                out += [(f"{opening} ", False), (self.escape(text), loss), (f" {closing}", False)]
            else:
                a, b, c = self.other
                out += [(f"{a}{self.escape(role)}{b} ", False), (self.escape(text), False), (f" {c}", False)]
        return out

    def parse(self, formatted: str) -> list[tuple[str, str, bool]]:
        """(role, text, bears loss) of each turn of a formatted conversation."""
        opened = {opening: (role, closing, loss) for role, (opening, closing, loss) in self.roles.items()}
        marks = list(self.pattern().finditer(formatted))
        out, k = [], 0
        while k < len(marks):
            if marks[k][0] == self.other[0]:
                if [m[0] for m in marks[k + 1 : k + 3]] != list(self.other[1:]):
                    raise ValueError("a turn is not closed")
                role, loss, body = self.unescape(formatted[marks[k].end() : marks[k + 1].start()]), False, k + 1
            else:
                role, closing, loss = opened[marks[k][0]]
                if k + 1 == len(marks) or marks[k + 1][0] != closing:
                    raise ValueError("a turn is not closed")
                body = k
            out.append((role, self.unescape(formatted[marks[body].end() + 1 : marks[body + 1].start() - 1]), loss))
            k = body + 2
        return out


#: Control strings in the style of instruction-tuned models; escaping never leaves one inside a text.
INSTRUCT = Template(
    roles={"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)},
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    other=("[ROLE]", "[NAMED]", "[/ROLE]"),
)


def conversations(rows: DataFrame) -> DataFrame:
    """One row for each conv_id with its turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, formatted, segments (text, loss), valid and first_refused of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            texts, parts, valid, refused = [], [], [], []
            for turns in batch.column(1).to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                segments = template.segments(pairs)
                parts.append([{"text": t, "loss": loss} for t, loss in segments])
                texts.append("".join(t for t, _ in segments))
                refused.append(template.check([r for r, _ in pairs]))
                valid.append(refused[-1] is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(parts, segment), pa.array(valid, pa.bool_()), pa.array(refused, pa.int64())], ["conv_id", "formatted", "segments", "valid", "first_refused"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_rows(conversations(rows), run, f"conv_id {kind}, formatted string, segments array<struct<text: string, loss: boolean>>, valid boolean, first_refused long")


def read_digests(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of turns, parsed from `formatted`, and of the text under the loss flags of `segments`, unescaped.

    Raises ValueError where the segments do not make up the formatted text, or their flags are not those of its turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            out: list[tuple] = []
            for text, segments in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = template.parse(text)
                flagged = [template.unescape(s["text"]) for s in segments if s["loss"]]
                if "".join(s["text"] for s in segments) != text or flagged != [t for _, t, bears in turns if bears]:
                    raise ValueError("segments differ from the formatted text")
                loss = "".join(flagged)
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _ in turns)), len(loss), sha(loss), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    return map_rows(formatted.select("conv_id", "formatted", "segments", "valid"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
