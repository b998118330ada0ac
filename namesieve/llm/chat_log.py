"""Conversations rebuilt from an event log, then rendered with a loss mask.

Events belong to a message (conversation, turn and, where a turn has several, a tie key) and have a sequence number:
``start`` opens the message and names its role, ``delta`` appends a streamed piece, ``edit`` replaces the text,
``regenerate`` throws it away so that later deltas build it anew. Partitioned by message and sorted by sequence, the
events are folded in one pass over the sorted stream; the state is one message, however long its conversation.

A message is rendered as ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a line break. In roles and
texts every ``<``, any backslashes, ``|`` gets one backslash more, which the reader takes away, so no text can pass
for a mark; line breaks and backslashes of a role are escaped too. The loss mask covers an assistant's text and
nothing else, as a range of code points of the rendered message. A conversation is the row of its messages in
order: it is never held as one value, so a conversation that holds a third of all rows is streamed. Its digest is a
hash over all of it, which has to be one stream, so ``summaries`` brings a conversation's messages to one task.

Defined results: a null text is empty, a null role is the empty role; a message without events other than ``start``
is empty; events of an unknown or null kind are skipped; ties are ordered by their tie key, events with equal
sequence numbers by kind and text; a null conversation or turn is a value of its own and comes first; an empty log
gives empty tables; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
EVENTS = ("conv_id", "turn", "tie", "seq", "kind", "role", "text")

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_MESSAGE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered message and where its loss mask begins and ends."""
    name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    head, body = f"{START}{name}\n", escape(text)
    stop = len(head) + len(body)
    return f"{head}{body}{END}\n", (len(head) if role == LEARNED else stop), stop


def parse(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    name, body = _MESSAGE.fullmatch(rendered).groups()
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))
    return role, unescape(body)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, role, parts = None, "", []
    names = ["conv_id", "turn", "tie", "formatted", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    started = False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        rows = []
        for conv, turn, tie, kind, named, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or (conv, turn, tie) != key:
                if started:
                    rows.append((*key, *render(role, "".join(parts))))
                key, role, parts, started = (conv, turn, tie), "", [], True
            if kind == "start":
                role = named or ""
            elif kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts = [text or ""]
            elif kind == "regenerate":
                parts = []
        if rows:
            yield batch_of(rows)
    if started:
        yield batch_of([(*key, *render(role, "".join(parts)))])


MESSAGES = "conv_id long, turn long, tie string, formatted string, loss_start long, loss_end long"


def messages(events: DataFrame) -> DataFrame:
    """The final, rendered messages of a log with the columns of ``EVENTS``: one row per message."""
    rows = events.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("tie").cast("string"),
        "seq", "kind", F.col("role").cast("string"), F.col("text").cast("string"),
    )
    keys = ["conv_id", "turn", "tie"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "kind", "text")
    return ordered.drop("seq").mapInArrow(_fold, MESSAGES)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv, state = None, None

    def row() -> tuple:
        n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        rows = []
        for this, formatted, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or this != conv:
                if state:
                    rows.append(row())
                conv, state = this, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            learned = unescape(formatted[start:stop])
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(formatted)
        if rows:
            yield batch_of(rows)
    if state:
        yield batch_of([row()])


SUMMARY = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def summaries(rendered: DataFrame) -> DataFrame:
    """Per conversation the digests of its rendered messages, read back in order."""
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_summary, SUMMARY)


def log_of(turns: DataFrame) -> DataFrame:
    """An event log of a table (conv_id, turn, role, text) whose fold gives the table again.

    Each row is started, a wrong draft is streamed, and then the draft is thrown away and the text streamed anew in
    three deltas (``regenerate``), or replaced by the text's first third and streamed on (``edit``); a hash of the row
    tells which. Sequence numbers have gaps, and later events stand before earlier ones.

    Rows of one turn are ordered by role and a hash of their text; equal rows are told apart by where they are.
    """
    hashed = F.xxhash64("role", "text")
    order = F.concat_ws(
        "/", F.coalesce("role", F.lit("")), F.hex(hashed), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    )
    third = F.ceil(F.length("text") / 3).cast("int")
    one, two, three = (F.substring("text", third * k + 1, third) for k in range(3))
    draft = F.reverse(F.substring("text", F.lit(1), third * 2))
    none = F.lit(None).cast("string")

    def log(*events: tuple[str, Column]) -> Column:
        steps = [F.struct(F.lit(10 * k).alias("seq"), F.lit(kind).alias("kind"), piece.alias("piece")) for k, (kind, piece) in enumerate(events)]
        return F.array(*reversed(steps))

    again = log(("start", none), ("delta", draft), ("regenerate", none), ("delta", one), ("delta", two), ("delta", three))
    edited = log(("start", none), ("delta", draft), ("edit", one), ("delta", two), ("delta", three))
    rows = turns.select("conv_id", "turn", "role", "text", hashed.alias("hashed")).withColumn("tie", order)
    rows = rows.withColumn("step", F.explode(F.when(F.col("hashed") % 2 == 0, again).otherwise(edited)))
    return rows.select(
        "conv_id", "turn", "tie", F.col("step.seq").alias("seq"), F.col("step.kind").alias("kind"), "role",
        F.col("step.piece").alias("text"),
    )
