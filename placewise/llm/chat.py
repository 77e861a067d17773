"""Chat formatting with a grammar round trip.

Each turn is rendered into the template, read again by a deterministic parser and compared with
its source. A turn that does not come back identical, or in whose text a control string stands, is
escaped: the escape character is doubled and put ahead of every control string. A conversation is
the concatenation of its turns, since the parser is back in its first state after each.

Grammar:  conversation = turn*;  turn = open(role) text close(role)
          system "<<SYS>>\\n" "\\n<</SYS>>\\n";  user "[INST] " " [/INST]";  assistant "<s> " "</s>"
          any other role "[ROLE " role "] " " [/ROLE]"

Chunks are rendered before the shuffle; a conversation is then read as a stream of sorted chunks,
so that its length is not bound by memory. Its digest is a chain over its turns and so one task's
work, at a few microseconds a turn.

Edge cases: null texts and roles are empty ones; turns are ordered by number (missing ones first),
then role, then text, so ties and repeated rows have a defined place and all stay; rows without a
conversation id are one conversation; other columns are ignored; no rows, no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import batch_of

ESCAPE = "\\"
#: Opening and closing strings of the template (fixed values).
SYSTEM, USER, ASSISTANT, OTHER = ("<<SYS>>\n", "\n<</SYS>>\n"), ("[INST] ", " [/INST]"), ("<s> ", "</s>"), ("[ROLE ", " [/ROLE]")
FORMS = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
ROLE_END = "] "
#: What may not stand in a text as it is.
CONTROL = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE", "[/ROLE]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile("|".join(map(re.escape, [ESCAPE, *CONTROL])))
_ROLE_ESCAPED = re.compile("|".join(map(re.escape, [ESCAPE, "]", *CONTROL])))


class ParseError(ValueError):
    pass


def escape(text: str, what: re.Pattern = _ESCAPED) -> str:
    return what.sub(lambda m: ESCAPE + m[0], text)


def render(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """A turn's chunk and where its text stands in it."""
    if role in FORMS:
        begin, end = FORMS[role]
    else:
        begin, end = OTHER[0] + escape(role, _ROLE_ESCAPED) + ROLE_END, OTHER[1]
    body = escape(text) if escaped else text
    return begin + body + end, len(begin), len(begin) + len(body)


def _read(s: str, at: int, end: str) -> tuple[str, int]:
    """Unescaped text up to the first ``end`` that isn't escaped, and where that ends."""
    out, stops = [], re.compile(f"{re.escape(ESCAPE)}|{re.escape(end)}|{_CONTROL.pattern}", re.S)
    while True:
        m = stops.search(s, at)
        if m is None:
            raise ParseError("a text has no end")
        out.append(s[at : m.start()])
        if m[0] == ESCAPE:
            if m.end() == len(s):
                raise ParseError("nothing to escape")
            out.append(s[m.end()])
            at = m.end() + 1
        elif s.startswith(end, m.start()):
            return "".join(out), m.start() + len(end)
        else:
            raise ParseError("a control string stands in a text")


def parse(s: str) -> list[tuple[str, str, int, int]]:
    """Turns (role, text, begin, end of the text in ``s``) of a formatted conversation; raises ``ParseError``."""
    turns, at = [], 0
    while at < len(s):
        for role, (begin, end) in FORMS.items():
            if s.startswith(begin, at):
                start = at + len(begin)
                break
        else:
            if not s.startswith(OTHER[0], at):
                raise ParseError("no turn begins here")
            role, start = _read_role(s, at + len(OTHER[0]))
            end = OTHER[1]
        text, at = _read(s, start, end)
        turns.append((role, text, start, at - len(end)))
    return turns


def _read_role(s: str, at: int) -> tuple[str, int]:
    out = []
    while True:
        if at >= len(s):
            raise ParseError("a role has no end")
        if s[at] == ESCAPE and at + 1 < len(s):
            out.append(s[at + 1])
            at += 2
        elif s.startswith(ROLE_END, at):
            role = "".join(out)
            if role in FORMS:
                raise ParseError("a named role in the general form")
            return role, at + len(ROLE_END)
        else:
            out.append(s[at])
            at += 1


def chunk_of(role: str, text: str) -> tuple[str, int, int]:
    """The first rendering, as it is or escaped, that parses back to exactly this turn."""
    for escaped in (False, True):
        chunk, begin, end = render(role, text, escaped)
        try:
            if parse(chunk) == [(role, text, begin, end)]:
                return chunk, begin, end
        except ParseError:
            continue
    raise AssertionError("an escaped turn does not come back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, chunk, begin, end) of a table (conv_id, turn, role, text): each turn's part of the formatted conversation."""
    fields = [
        pa.field("conv_id", pa.int64()), pa.field("turn", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string()),
        pa.field("chunk", pa.string()), pa.field("begin", pa.int64()), pa.field("end", pa.int64()),
    ]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            made = [chunk_of(r, t) for r, t in zip(cols[2], cols[3], strict=True)]
            yield batch_of(fields, dict(zip([f.name for f in fields], [*cols, *map(list, zip(*made, strict=True))] if made else [[]] * 7, strict=True)))

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return turns.mapInArrow(run, "conv_id long, turn long, role string, text string, chunk string, begin long, end long")


def _in_order(formatted: DataFrame) -> DataFrame:
    width = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    return formatted.repartition(width, "conv_id").sortWithinPartitions(*order)


def placed(formatted: DataFrame) -> DataFrame:
    """Adds position (from 0) and offset (code points) of each chunk in its conversation, and the loss span there (null but for assistants)."""
    fields = [pa.field(n, pa.string() if n in ("role", "chunk") else pa.int64()) for n in ("conv_id", "position", "role", "chunk", "offset", "loss_begin", "loss_end")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, offset = object(), 0, 0
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in fields}
            for conv, role, chunk, begin, end in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if conv != now:
                    now, position, offset = conv, 0, 0
                mask = role == "assistant"
                for name, value in zip(out, (conv, position, role, chunk, offset, offset + begin if mask else None, offset + end if mask else None), strict=True):
                    out[name].append(value)
                position += 1
                offset += len(chunk)
            yield batch_of(fields, out)

    ordered = _in_order(formatted).select("conv_id", "role", "chunk", "begin", "end")
    return ordered.mapInArrow(run, "conv_id long, position long, role string, chunk string, offset long, loss_begin long, loss_end long")


class _Digest:
    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, chunk: str) -> None:
        for role, text, _, _ in parse(chunk):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        self.chars += len(chunk)

    def row(self) -> list:
        return [self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


def digest(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its chunks."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    fields = [pa.field(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            done = []
            for conv, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is None or conv != now:
                    if own is not None:
                        done.append([now, *own.row()])
                    now, own = conv, _Digest()
                own.add(chunk)
            yield batch_of(fields, {n: [d[k] for d in done] for k, n in enumerate(names)})
        if own is not None:
            yield batch_of(fields, {n: [x] for n, x in zip(names, [now, *own.row()], strict=True)})

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _in_order(formatted).select("conv_id", "chunk").mapInArrow(run, ddl)
