"""Chat formatting from an event log.

Events are (conv, seq, msg, kind, role, text): `delta` adds text to a message, `edit` sets its text anew and
`regenerate` empties it and gives it a new role if one is named. Events are dealt by message and folded in order of their
sequence; what is left of each message is dealt by conversation, sorted by its first event and rendered into one piece, with
its offset in the conversation. Every pass streams over sorted rows and holds one message, so that a conversation with a third
of all rows needs no more memory than any other; its pieces are numbered, and its digests taken, by one task after another
row, for both are running sums in order.

Template: `<s>[INST] user [/INST]`, ` assistant </s>`, `[ROLE] name\\ntext [/ROLE]` for every other role.
Control strings inside texts (and role names) get one more backslash after their first character, which
reading back removes; line breaks and backslashes in role names are written `\\n` and `\\\\`; everything else stays as it is,
so that the round trip is exact.

Null texts are empty, null roles the empty role; events with a null conversation form a conversation of
their own. Ties in seq go by kind, role, text, then message. Repeated rows are repeated events. An empty log
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches

CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\])")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def role_name(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(name: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))


def piece(role: str, text: str) -> tuple[str, int, int]:
    """One turn as formatted, and the span of it under the loss mask (-1, -1 but for assistants)."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST] {body} [/INST]", -1, -1
    if role == "assistant":
        return f" {body} </s>", 1, 1 + len(body)
    return f"[ROLE] {role_name(role)}\n{body} [/ROLE]", -1, -1


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, or of any run of its pieces."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith("<s>[INST] ", at):
            end = formatted.index(" [/INST]", at + 9)
            turns.append(("user", unescape(formatted[at + 10 : end])))
            at = end + 8
        elif formatted.startswith("[ROLE] ", at):
            end = formatted.index(" [/ROLE]", at + 6)
            role, _, text = formatted[at + 7 : end].partition("\n")
            turns.append((role_of(role), unescape(text)))
            at = end + 8
        else:
            end = formatted.index(" </s>", at)
            turns.append(("assistant", unescape(formatted[at + 1 : end])))
            at = end + 5
    return turns


class Message:
    """What is left of one message's events, taken in order."""

    def __init__(self) -> None:
        self.role, self.parts = "", []

    def take(self, kind: str, role: str | None, text: str | None) -> None:
        if role is not None:
            self.role = role
        if kind == "delta":
            self.parts.append(text or "")
        elif kind == "edit":
            self.parts = [text or ""]
        elif kind == "regenerate":
            self.parts = []

    @property
    def text(self) -> str:
        return "".join(self.parts)


BATCH = 1 << 22


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows whose last item is their size in characters, in batches of bounded size."""
    held, chars = [], 0
    for *row, size in rows:
        held.append(row)
        chars += size + 64
        if chars > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def messages(events: DataFrame) -> DataFrame:
    """conv, msg, role, text of every message as its events left it, with seq, kind, role0 and text0 of its first event."""
    rows = small_batches(events).select("conv", "msg", "seq", "kind", "role", "text")
    kind = dict(rows.dtypes)
    names = ["conv", "msg", "seq", "kind", "role0", "text0", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()

        def folded() -> Iterator[tuple]:
            key, first, now = none, None, Message()
            for conv, msg, seq, what, role, text in _rows(batches):
                if (conv, msg) != key:
                    if key is not none:
                        yield *first, now.role, now.text, sum(map(len, now.parts))
                    key, first, now = (conv, msg), (conv, msg, seq, what, role, text), Message()
                now.take(what, role, text)
            if key is not none:
                yield *first, now.role, now.text, sum(map(len, now.parts))

        kinds = [ARROW[kind[c]] for c in ("conv", "msg", "seq")] + [pa.string()] * 5
        yield from _batches(folded(), kinds, names)

    dealt = rows.repartition("conv", "msg").sortWithinPartitions("conv", "msg", "seq", "kind", "role", "text")
    return dealt.mapInArrow(run, f"conv {kind['conv']}, msg {kind['msg']}, seq {kind['seq']}, kind string, role0 string, text0 string, role string, text string")


def pieces(events: DataFrame) -> DataFrame:
    """conv, position, start, piece, loss_start, loss_stop: one row a message, a conversation's rows one after another in one
    partition; piece is what stands from start on, the loss span counts from the piece's first character."""
    rows = messages(events)
    kind = dict(rows.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()

        def placed() -> Iterator[tuple]:
            last, position, start = none, 0, 0
            for conv, role, text in _rows(batches):
                if conv != last:
                    last, position, start = conv, 0, 0
                out, a, b = piece(role, text)
                yield conv, position, start, out, a, b, len(out)
                position, start = position + 1, start + len(out)

        yield from _batches(placed(), [ARROW[kind], pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()], ["conv", "position", "start", "piece", "loss_start", "loss_stop"])

    order = rows.repartition("conv").sortWithinPartitions("conv", "seq", "kind", "role0", "text0", "msg").select("conv", "role", "text")
    return order.mapInArrow(run, f"conv {kind}, position long, start long, piece string, loss_start long, loss_stop long")


def formatted(events: DataFrame) -> DataFrame:
    """conv, formatted, spans: one row for each conversation, whose pieces have to fit one task; `pieces` have no such limit."""
    rows = pieces(events).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("position", "start", "piece", "loss_start", "loss_stop"))).alias("p"))
    spans = F.transform(F.filter("p", lambda p: p["loss_start"] >= 0), lambda p: F.struct((p["start"] + p["loss_start"]).alias("start"), (p["start"] + p["loss_stop"]).alias("stop")))
    return rows.select("conv", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"), spans.alias("spans"))


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read_back(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()

        def read() -> Iterator[tuple]:
            last = none
            for conv, start, text, a, b in _rows(batches):
                if conv != last:
                    if last is not none:
                        yield last, n, turns.hexdigest(), chars, loss.hexdigest(), size, 256
                    last, n, turns, chars, loss, size = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                if start != size:
                    raise ValueError(f"a piece of conversation {conv} is missing before {start}")
                for role, body in parse(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                if a >= 0:
                    own = unescape(text[a:b])
                    loss.update(own.encode())
                    chars += len(own)
                size += len(text)
            if last is not none:
                yield last, n, turns.hexdigest(), chars, loss.hexdigest(), size, 256

        yield from _batches(read(), [ARROW[kind], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], DIGESTS)

    return run


def read_back(out: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from pieces alone. in_order says that the rows come straight
    from `pieces`; those of a table are dealt and sorted again."""
    kind = dict(out.dtypes)["conv"]
    rows = out if in_order else out.repartition("conv").sortWithinPartitions("conv", "position")
    return rows.select("conv", "start", "piece", "loss_start", "loss_stop").mapInArrow(_read_back(kind), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as the log that would have left them. Each turn is a message of its own, repeated turns too: an
    assistant's first draft is thrown away by a regeneration, any other is cut to its first half by an edit; the final text
    then comes in what deltas are left to come. Rows without a turn come first."""
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.coalesce("turn", F.lit(-(1 << 60))).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("msg", F.monotonically_increasing_id())
    half = F.floor(F.length("text") / 2).cast("int")
    left, right = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    one = lambda step, kind, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    draft = one(0, "delta", F.col("text"))
    spoken = F.array(draft, one(1, "regenerate", F.lit("")), one(2, "delta", left), one(3, "delta", right))
    typed = F.array(draft, one(1, "edit", left), one(2, "delta", right))
    events = rows.select("conv", "turn", "msg", "role", F.explode(F.when(F.col("role") == "assistant", spoken).otherwise(typed)).alias("e"))
    return events.select("conv", (F.col("turn") * 4 + F.col("e.step")).alias("seq"), "msg", "e.kind", "role", "e.text")
