"""Chat formatting: records of any known layout to canonical turns, turns to one marked text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedproj.llm.common import small_batches, to_batch


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: which paths a record has, and which of them make its turns.

    ``each`` names a list of turns with fields ``role`` and ``text``; otherwise ``turns``
    lists (role, path) pairs, where a role of ``@path`` is read from the record and an
    absent or empty optional path gives no turn.
    """

    name: str
    paths: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    order: str = ""


HUMAN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn_row", ("turn", "role", "text"), turns=(("@role", "text"),), order="turn"),
    Layout("messages", ("messages", "messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=HUMAN),
    Layout("role_text_list", ("turns", "turns[].role", "turns[].text"), each="turns", role="role", text="text", roles=HUMAN),
    Layout("prompt_response", ("prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output"), turns=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Layout("question_answer", ("question", "answer"), turns=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
)


def field_paths(value, at: str = "") -> set[str]:
    """Every nested field path of a record; list items share the path ``[]``."""
    if isinstance(value, dict):
        inner = [(f"{at}.{k}" if at else str(k), v) for k, v in value.items()]
        return {p for p, _ in inner}.union(*(field_paths(v, p) for p, v in inner))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return set()


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


class Selector:
    """Layouts by fingerprint. A new fingerprint takes the layout with most paths that it contains."""

    def __init__(self, layouts: Iterable[Layout] = LAYOUTS):
        self.layouts = sorted(layouts, key=lambda x: -len(x.paths))
        self.known: dict[str, Layout | None] = {fingerprint(x.paths): x for x in self.layouts}

    def find(self, record) -> tuple[str, Layout | None]:
        paths = field_paths(record)
        print_ = fingerprint(paths)
        if print_ not in self.known:
            if len(self.known) > 100_000:
                self.known = {fingerprint(x.paths): x for x in self.layouts}
            self.known[print_] = next((x for x in self.layouts if paths.issuperset(x.paths)), None)
        return print_, self.known[print_]


def _string(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[int, str, str]]:
    """(order, role, text) of a record's turns."""
    if layout.each:
        items = [x if isinstance(x, dict) else {} for x in record.get(layout.each) or []]
        pairs = [(_string(x.get(layout.role)), _string(x.get(layout.text))) for x in items]
    else:
        pairs = []
        for role, path in layout.turns:
            if role[0] == "@":
                pairs.append((_string(record.get(role[1:])), _string(record.get(path))))
            elif parts := [_string(record[p]) for p in path.split("+") if record.get(p)]:
                pairs.append((role, "\n\n".join(parts)))
            elif path in layout.paths:
                pairs.append((role, ""))
    first = record.get(layout.order) if layout.order else 0
    first = first if isinstance(first, int) else 0
    return [(first + i, layout.roles.get(r, r), t) for i, (r, t) in enumerate(pairs)]


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, key: str = "conv_id", record: str = "record") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``fingerprint``, ``layout`` from JSON records.

    NULL texts are empty, NULL roles the empty role. A record that is NULL, no JSON object or
    of a layout that none fits gives one row without a role (``role`` and ``layout`` NULL),
    so it can be counted and is never lost silently.
    """
    small_batches(records.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), *((n, pa.string()) for n in ("role", "text", "fingerprint", "layout"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        select = Selector(layouts)
        for batch in batches:
            rows = []
            for conv, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(said) if said else None
                except ValueError:
                    value = None
                print_, layout = select.find(value) if isinstance(value, dict) else (None, None)
                if layout is None:
                    rows.append((conv, 0, None, None, print_, None))
                else:
                    rows += [(conv, *turn, print_, layout.name) for turn in turns_of(value, layout)]
            yield to_batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * 6)

    return records.select(F.col(f"`{key}`").cast("bigint").alias("conv_id"), F.col(f"`{record}`").cast("string").alias("record")).mapInArrow(
        run, "conv_id bigint, turn bigint, role string, text string, fingerprint string, layout string"
    )


#: The markers of a turn by role; any other role uses OTHER with its name.
MARKERS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
}
OTHER = ("[ROLE]", "[TEXT]", "[/TEXT]")
CONTROLS = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|\[ROLE\]|\[/?TEXT\]")


def escape(text: str) -> str:
    """Doubles backslashes and breaks each control string by one after its first character."""
    return CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The marked text of (role, text) turns, and the spans of the assistant's escaped texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        if role in MARKERS:
            open_, close = MARKERS[role]
        else:
            open_, close = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(open_), at + len(open_) + len(body)))
        parts += [open_, body, close]
        at += len(open_) + len(body) + len(close)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns, at = [], 0
    by_open = {open_: (role, close) for role, (open_, close) in MARKERS.items()}
    while at < len(formatted):
        for open_, (role, close) in by_open.items():
            if formatted.startswith(open_, at):
                start = at + len(open_)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn begins at {at}")
            start = formatted.index(OTHER[1], at) + len(OTHER[1])
            role, close = unescape(formatted[at + len(OTHER[0]) : start - len(OTHER[1])]), OTHER[2]
        end = formatted.index(close, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(close)
    return turns


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss`` (spans of characters) of each conversation.

    Turns are ordered by ``turn``, then role and text, so ties are stable; repeated rows are
    repeated turns; rows without a role (no known layout) make no turn. A conversation is one
    text, so its turns meet in one row. NULL conversation ids form one conversation.
    """
    grouped = turns.where("role is not null").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(t["role"], t["text"] or "") for t in x]) for x in batch.column(1).to_pylist()]
            yield to_batch(schema, [batch.column(0), [m for m, _ in made], [[{"start": a, "end": b} for a, b in s] for _, s in made]])

    return grouped.mapInArrow(run, "conv_id bigint, formatted string, loss array<struct<start:int,end:int>>")


def turn_records(rows: DataFrame, *columns: str) -> Column:
    """A row of a turn table as a JSON record, NULL fields included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
