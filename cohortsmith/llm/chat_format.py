"""Chat formatting: heterogeneous records become canonical turns, turns become one marked-up text.

A record's schema fingerprint is a hash of its nested field paths (those that any mapping names; others
don't matter). It selects a declarative mapping, which says where turns, roles and texts lie. A typed table
has the fingerprint of its schema: it selects a mapping for a row for each turn (ROW_MAPPINGS) or for each record (MAPPINGS).

A turn reads `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts `<`, any backslashes, `|` gets
one backslash more, so that no control string can occur there and reading takes it off again; in roles
backslashes and line breaks are escaped before that. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import tidy

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Characters after which a conversation's text goes on in another row (at the end of a turn).
PART = 1 << 20

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: path of a list of turns with fields role and text; else conversation and order: columns of a table with a row
    for each turn, beside role and text; else fields: (path, role) in order of the turns."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = field(default=())
    conversation: str = ""
    order: str = ""

    def paths(self) -> frozenset[str]:
        if self.turns:
            return frozenset((f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"))
        if self.conversation:
            return frozenset((self.conversation, self.order, self.role, self.text))
        return frozenset(p for p, _ in self.fields)

    def fingerprints(self) -> list[str]:
        """One for each choice of optional paths."""
        out = [self.paths()]
        for p in self.optional:
            out += [x - {p} for x in out]
        return [fingerprint(x) for x in out]


MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("conversations", "conversations", "from", "value"),
    Mapping("dialogue", "dialog.turns", "speaker", "text"),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Mapping("prompt", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("question", fields=(("question", "user"), ("answer", "assistant"))),
)
#: Tables with a row for each turn.
ROW_MAPPINGS = (
    Mapping("turn rows", conversation="conv_id", order="turn", role="role", text="text"),
    Mapping("message rows", conversation="conversation_id", order="position", role="author", text="content"),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def record_paths(value, at: str = "") -> Iterator[str]:
    """The field paths of a parsed record: a.b, and a[].b inside lists. A null has the path of its place."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from record_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from record_paths(v, f"{at}[]")
    else:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """The field paths of a table's schema."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def selected(paths, mappings=MAPPINGS) -> tuple[str, Mapping | None]:
    """The fingerprint over the paths that mappings name, and the mapping it selects.

    Where a layout has paths of several mappings, that whole fingerprint is unknown; the fingerprint over each mapping's own
    paths then selects, if it does for one mapping alone.
    """
    paths = set(paths)
    mark = fingerprint(paths & frozenset().union(*(m.paths() for m in mappings)))
    found = [m for m in mappings if mark in m.fingerprints()] or [m for m in mappings if fingerprint(paths & m.paths()) in m.fingerprints()]
    return mark, found[0] if len(found) == 1 else None


def _at(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def mapped(record, mapping: Mapping) -> list[tuple[str, str]]:
    if mapping.turns:
        found = [(_text(_at(t, mapping.role)), _text(_at(t, mapping.text))) for t in _at(record, mapping.turns) or [] if isinstance(t, dict)]  # a null turn is none
    else:
        found = [(role, _text(v)) for p, role in mapping.fields if (v := _at(record, p)) is not None or p not in mapping.optional]
    out: list[tuple[str, str]] = []
    for role, text in found:
        role = ROLES.get(role.lower(), role)
        if out and out[-1][0] == role == "user" and not mapping.turns:
            out[-1] = (role, f"{out[-1][1]}\n\n{text}")  # an instruction and its input are one turn
        else:
            out.append((role, text))
    return out


def turns_of(records: DataFrame, column: str = "record", mappings=MAPPINGS, mapping: Mapping | None = None) -> DataFrame:
    """(conv_id, turn, role, text, fingerprint) from JSON records (conv_id, `column`), each by its own fingerprint, or all by `mapping`.

    A record that is null, no JSON object, without turns, or has a fingerprint that no mapping knows gives one row with
    null turn, role and text and its fingerprint (null where there is none): nothing is lost unseen.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[frozenset, tuple] = {}
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rows.append((name, None, None, None, None))
                    continue
                paths = frozenset(record_paths(record))
                if paths not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[paths] = selected(paths, mappings)
                mark, own = known[paths]
                own = mapping or own
                turns = mapped(record, own) if own else []
                rows += [(name, i, role, text, mark) for i, (role, text) in enumerate(turns)] or [(name, None, None, None, mark)]
            c = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.string()) for x in c[2:])], names=["conv_id", "turn", "role", "text", "fingerprint"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(column).cast("string").alias("record")).mapInArrow(tidy(read), "conv_id long, turn long, role string, text string, fingerprint string")


def turns_table(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, empty): the canonical turns of a typed table, by the mapping that its schema's fingerprint selects.

    A table has a row for each turn, or for each record with conv_id. A record without turns gives one row that is
    `empty`, so that its conversation stays, with no turns. Columns that no mapping names are ignored. ValueError, if no mapping is selected.
    """
    paths = set(schema_paths(table.schema))
    _, mapping = selected(paths, ROW_MAPPINGS)
    if mapping:
        return table.select(F.col(mapping.conversation).cast("long").alias("conv_id"), F.col(mapping.order).cast("long").alias("turn"), F.col(mapping.role).cast("string").alias("role"), F.col(mapping.text).cast("string").alias("text"), F.lit(False).alias("empty"))
    _, mapping = selected(paths)
    if mapping is None or "conv_id" not in paths:
        raise ValueError(f"no mapping has the fingerprint of {sorted(paths)}")
    tops = {p.split(".")[0].removesuffix("[]") for p in mapping.paths()}
    record = F.to_json(F.struct(*(c for c in table.columns if c in tops)), {"ignoreNullFields": "false"})
    found = turns_of(table.select("conv_id", record.alias("record")), mapping=mapping)
    return found.select("conv_id", "turn", "role", "text", F.col("turn").isNull().alias("empty"))


_OPENS, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return _OPENS.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def formatted(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, text, loss) from turns (conv_id, turn, role, text).

    Turns are ordered by turn (null first), then role and text. A null role or text is empty. text is a
    part of the conversation's text, part a number that orders them; most have one part, long ones go on in further rows. Ranges
    of (conv_id, turn) are dealt to tasks, so that one conversation of any length is formatted by many, each in bounded
    memory. loss: [(start, end)] in the part's code points. A row that is `empty` (a Boolean column that turns may have)
    is no turn: its conversation has an empty text if it has no others. Other columns are ignored.
    """
    empty = F.coalesce("empty", F.lit(False)) if dict(turns.dtypes).get("empty") == "boolean" else F.lit(False)
    one = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), empty.alias("empty"))
    dealt = one.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(tidy(_format(part)), "conv_id long, part long, text string, loss array<struct<start:long,stop:long>>")


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _format(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32  # ranges follow each other
        name, part, pieces, size, loss, begun, rows = None, base, [], 0, [], False, []
        for batch in batches:
            for conv, role, text, empty in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "empty")), strict=True):
                if begun and (conv != name or size >= most):
                    rows.append((name, part, "".join(pieces), loss))
                    part, pieces, size, loss = part + 1 if conv == name else base, [], 0, []
                begun, name = True, conv
                if empty:
                    continue
                head, body = f"{START}{_role_out(role)}\n", escaped(text)
                if role == ASSISTANT:
                    loss.append({"start": size + len(head), "stop": size + len(head) + len(body)})
                pieces += [head, body, END, "\n"]
                size += len(head) + len(body) + len(END) + 1
            yield _batch(rows)
            rows = []
        if begun:
            yield _batch([(name, part, "".join(pieces), loss)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_PARTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS, strict=True)], schema=_PARTS)


def parsed(text: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, place of the text) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        yield _role_in(text[at + len(START) : line]), unescaped(text[line + 1 : end]), line + 1
        at = end + len(END) + 1


def read_back(formatted_: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted()'s rows, read from their texts and masks.

    A digest goes through a conversation from its start to its end, in one task, which reads it part by part.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, begun = None, False
        n = chars = learned = 0
        turns = loss = hashlib.sha256()

        def row():
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([name], pa.int64()), "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [learned], "loss_sha256": [loss.hexdigest()], "formatted_chars": [chars]})

        for batch in batches:
            for conv, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                if not begun or conv != name:
                    if begun:
                        yield row()
                    begun, name, n, chars, learned, turns, loss = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, body, _ in parsed(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for s in spans:
                    body = unescaped(text[s["start"] : s["stop"]])
                    learned += len(body)
                    loss.update(body.encode())
                chars += len(text)
        if begun:
            yield row()

    return formatted_.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(tidy(read), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
