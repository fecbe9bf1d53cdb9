"""Chat formatting from event logs.

A log has one row per event: a message is opened, grows by streamed deltas, is edited, generated anew or deleted.  Logs are partitioned by
conversation, a long one over several tasks by its message numbers, and sorted by conversation, message and sequence.  Each task folds a message's
events into its final text, one message at a time, and renders it at once; what a task returns are parts of formatted
conversations of at most ``PART`` code points (a longer message is a part of its own) with the spans of the loss mask.  So a conversation of any
length is rendered in parallel and in bounded memory, and no task holds more than one message and one part.

Event kinds: ``message`` opens a message (always another one, if the number was used before), ``delta`` appends, ``edit`` replaces the text and, if
it has one, the role, ``regenerate`` drops the text so that deltas write it anew, ``delete`` takes the message out.  A delta, edit or regeneration
of a message never opened opens it; events that follow a deletion, other than an opening, are ignored; an unknown kind is an error.

Control strings within texts and roles are escaped by one backslash after their first character; where backslashes stand there already, one is
added.  Reading takes one away again, so every text comes back as it was, and one without control strings is not changed at all.

Edge cases: a null text or role is empty; a null ``conv_id`` is a conversation of its own; null numbers come first; ties of sequence are in
any order, so the query breaks them by role, text and row; in the query rows that repeat a turn are turns of their own; an empty log gives no parts (the query still
has its made conversation -1); columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mapped, partitions

EVENTS = ("message", "delta", "edit", "regenerate", "delete")
LEARNT = "assistant"
PART = 1 << 20
PARTS = "conv_id long, message long, part int, turns int, formatted string, loss array<struct<start:long,length:long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """What stands before and after the text of each role, and of any other role before its name, between name and text, and after the text.

    ``controls`` are the strings that texts must not hold unescaped; each mark has one of them.
    """

    controls: tuple[str, ...]
    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    stuff: re.Pattern = field(init=False, repr=False, compare=False)
    strip: re.Pattern = field(init=False, repr=False, compare=False)
    opening: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        cs = self.controls
        if not all(len(c) > 1 and "\\" not in c for c in cs):
            raise ValueError("a control string has two characters at least and no backslash")
        if any(a[-n:] == b[:n] for a in cs for b in cs for n in range(1, min(len(a), len(b)))) or any(a in b for a in cs for b in cs if a != b):
            raise ValueError("control strings that overlap can't be told apart")
        if not all(any(c in mark for c in cs) for mark in [*self.other, *(m for pair in self.marks.values() for m in pair)]):
            raise ValueError("every mark needs a control string")
        object.__setattr__(self, "stuff", re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in cs)))
        object.__setattr__(self, "strip", re.compile("|".join(f"({re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in cs)))
        starts = sorted([*(o for o, _ in self.marks.values()), self.other[0]], key=len, reverse=True)
        object.__setattr__(self, "opening", re.compile("|".join(map(re.escape, starts))))

    def escape(self, text: str) -> str:
        return self.stuff.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self.strip.sub(lambda m: m[0][0], text)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn, and where its text lies in it."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        body = self.escape(text)
        return before + body + after, len(before), len(body)

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn."""
        closes = {before: (role, after) for role, (before, after) in self.marks.items()}
        at = 0
        while at < len(formatted):
            start = self.opening.match(formatted, at)
            if not start:
                raise ValueError(f"no turn at {at}")
            at = start.end()
            if start[0] in closes:
                role, after = closes[start[0]]
            else:
                stop = formatted.index(self.other[1], at)
                role, after = self.unescape(formatted[at:stop]), self.other[2]
                at = stop + len(self.other[1])
            stop = formatted.index(after, at)
            yield role, self.unescape(formatted[at:stop])
            at = stop + len(after)


INSTRUCT = Template(
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>"),
    marks={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>\n")},
    other=("<<ROLE>>", "<<TEXT>>", "<</ROLE>>\n"),
)
CHATML = Template(
    controls=("<|im_start|>", "<|im_end|>", "<|im_sep|>"),
    marks={r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")},
    other=("<|im_start|>", "<|im_sep|>", "<|im_end|>\n"),
)


class Message:
    """A message as its events leave it."""

    def __init__(self):
        self.role, self.pieces, self.gone = "", [], False

    def take(self, kind: str, role: str | None, text: str | None) -> None:
        if kind not in EVENTS:
            raise ValueError(f"unknown event {kind!r}")
        if self.gone:
            return
        if kind == "delete":
            self.gone, self.pieces = True, []
            return
        if kind != "delta":
            self.pieces = []
        if role and (kind in ("message", "edit") or not self.role):
            self.role = role
        if text and kind != "regenerate":
            self.pieces.append(text)


def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, Message]]:
    """Conversation, number and final state of each message of sorted events."""
    at, now = None, None
    for batch in batches:
        for conv, number, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text")), strict=True):
            if now is None or (conv, number) != at or kind == "message":
                if now is not None and not now.gone:
                    yield *at, now
                at, now = (conv, number), Message()
            now.take(kind, role, text)
    if now is not None and not now.gone:
        yield *at, now


def format_chats(log: DataFrame, template: Template = INSTRUCT, learnt: str = LEARNT, most: int = PART) -> DataFrame:
    """Formatted conversations of (conv_id, message, seq, kind, role, text), as parts.

    ``seq`` may be of any type that sorts.  A conversation is its parts by ``message`` (the number of the first one in it) and ``part``; ``loss`` are
    the spans, in code points of the part, of the texts of role ``learnt``.
    """
    n = partitions(log.sparkSession)
    dealt = log.select("conv_id", "message", "seq", "kind", "role", "text").repartitionByRange(n, "conv_id", "message").sortWithinPartitions("conv_id", "message", "seq")

    def run(rows: Iterator[tuple[int | None, int | None, Message]]) -> Iterator[tuple]:
        held, spans, size, at, index = [], [], 0, None, 0
        for conv, number, message in rows:
            turn, start, length = template.render(message.role, "".join(message.pieces))
            if held and (conv != at[0] or size + len(turn) > most):
                yield *at, index, len(held), "".join(held), spans
                index = index + 1 if conv == at[0] else 0
                held, spans, size = [], [], 0
            if not held:
                at = (conv, number)
            if message.role == learnt:
                spans.append({"start": size + start, "length": length})
            held.append(turn)
            size += len(turn)
        if held:
            yield *at, index, len(held), "".join(held), spans

    return dealt.select("conv_id", "message", "kind", "role", "text").transform(mapped, lambda batches: told(run(messages(batches)), PARTS), PARTS)


class Digest:
    """What is read from a conversation's parts, one after the other."""

    def __init__(self, template: Template):
        self.template, self.turns, self.learnt = template, hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.length = 0

    def take(self, formatted: str, loss: list[dict]) -> None:
        for role, text in self.template.read(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for span in loss:
            text = self.template.unescape(formatted[span["start"] : span["start"] + span["length"]])
            self.learnt.update(text.encode())
            self.chars += len(text)
        self.length += len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.chars, self.learnt.hexdigest(), self.length


def rows_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def told(rows: Iterator[tuple], schema: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows, cut by rows and by the length of their texts."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [c.split(maxsplit=1) for c in schema.split(", ")]
    types = [kinds.get(t) or pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])) for _, t in fields]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


#: Parts, or in their place what was read from a whole conversation.
MIXED = f"{PARTS.replace('turns int, ', '')}, {READ.removeprefix('conv_id long, ')}"
_PART = ["conv_id", "message", "part", "formatted", "loss"]


def within_task(rows: Iterator[tuple], template: Template, most: int) -> Iterator[tuple]:
    """Sorted parts of a task: conversations between the first and the last are read at once, those two and very long ones passed on as parts."""
    at, held, size, start, passed = None, [], 0, True, True
    for row in rows:
        if start or row[0] != at:
            if held:
                digest = Digest(template)
                for r in held:
                    digest.take(r[3], r[4])
                yield at, None, None, None, None, *digest.row()
            at, held, size, passed, start = row[0], [], 0, start, False
        if not passed:
            held.append(row)
            size += len(row[3])
            passed = size > most
            if passed:
                yield from ((*r, None, None, None, None, None) for r in held)
                held = []
        else:
            yield *row, None, None, None, None, None
    yield from ((*r, None, None, None, None, None) for r in held)


def read_back(parts: DataFrame, template: Template = INSTRUCT, ranged: bool = False, most: int = 16 * PART) -> DataFrame:
    """What can be read from formatted conversations: turns, texts under the loss mask, digests.

    A digest runs along its conversation, so the parts of one go through a task in order, one at a time.  With ``ranged`` (only for what
    ``format_chats`` itself returns, whose tasks hold ranges of conversations) just those at the ends of a task's range, or of over ``most``
    code points, are shuffled for it.
    """
    parts = parts.select(*_PART)
    whole = None
    if ranged:
        mixed = cut(parts.transform(mapped, lambda batches: told(within_task(rows_of(batches, _PART), template, most), MIXED), MIXED))
        names = [c.split()[0] for c in READ.split(", ")]
        whole, parts = mixed.where("formatted IS NULL").select(*names), mixed.where("formatted IS NOT NULL").select(*_PART)
    dealt = parts.repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "message", "part")

    def along(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, digest = None, None
        for conv, formatted, loss in rows:
            if digest is None or conv != at:
                if digest is not None:
                    yield at, *digest.row()
                at, digest = conv, Digest(template)
            digest.take(formatted, loss)
        if digest is not None:
            yield at, *digest.row()

    read = dealt.select("conv_id", "formatted", "loss").transform(mapped, lambda batches: told(along(rows_of(batches, ["conv_id", "formatted", "loss"])), READ), READ)
    return read if whole is None else whole.union(read)


#: A text that looks like this template's own marks.
MADE = "</s>[INST] ok [/INST]"


def log_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The events of (conv_id, turn, role, text): a message is opened for each row, and an assistant's text streams in line by line."""
    made = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(MADE).alias("text"))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(made)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    streams = F.col("role") == LEARNT
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    opened = F.array(event("message", F.when(streams, "").otherwise(F.col("text"))))
    deltas = F.when(streams, F.transform(F.split("text", r"(?<=\n)"), lambda x: event("delta", x))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    events = rows.select("conv_id", F.col("turn").alias("message"), "role", F.xxhash64("text").alias("of"), "row", F.posexplode(F.concat(opened, deltas)).alias("at", "event"))
    return events.select("conv_id", "message", F.struct("role", "of", "row", "at").alias("seq"), "event.kind", "role", "event.text")


def op13_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back."""
    from .common import table

    return read_back(format_chats(log_of(spark, table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))), ranged=True)


_LENGTHS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in INSTRUCT.marks.items())
_CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE>>|<TEXT>>|</ROLE>>)"
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{MADE}'), (-1, 1, 'assistant', '{MADE}')
), t AS (SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) + CASE role {_LENGTHS} ELSE {sum(map(len, INSTRUCT.other))} + length(role) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
