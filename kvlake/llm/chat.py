"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``start`` opens a message with its role,
``delta`` appends streamed text, ``edit`` replaces a message's text so far, and
``regenerate`` throws a message's text away to stream it again.  Events are dealt
by conversation and message, sorted by sequence (on disk where need be) and
folded in one streaming pass that holds a message at a time.  Messages are then
rendered with a template.

The template marks each turn with ``<turn>``, ``### Role:`` and ``</turn>``.
Texts and roles are escaped so that none of these can arise inside: a backslash
goes before every backslash, ``<`` and ``#`` (and ``:`` in roles).  ``parse`` undoes it.

Defined results: a null text is empty; a null role is an empty role.  Events of
one (conversation, turn) with equal sequence are taken in order of kind and
text.  A null conv_id is a conversation of its own; null turns come first.
Conversations without events give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.llm.common import bound_batches

START, DELTA, EDIT, REGENERATE = "start", "delta", "edit", "regenerate"
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"
OPEN, CLOSE, HEAD = "<turn>\n", "</turn>\n", "### "
_SPECIAL = re.compile(r"([\\<#])")
_COLON = "\\:"
_ESCAPED = re.compile(r"\\([\\<#:])")
_TURN = re.compile(r"<turn>\n### ((?:[^\\:<#]|\\[\\<#:])*+): ((?:[^\\<#]|\\[\\<#])*+)</turn>\n")


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    """One turn.  The first bare colon ends the role, so a role's own are escaped too."""
    return f"{OPEN}{HEAD}{escape(role).replace(':', _COLON)}: {escape(text)}{CLOSE}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def messages_to_events(messages: DataFrame, pieces: int = 3) -> DataFrame:
    """A log of events that ends in the given messages (conv_id, turn, role, text).

    Rows of one (conv_id, turn) stay separate messages, numbered by role and text as ``part``.

    A text is streamed as up to ``pieces`` deltas.  Every second user message is
    first sent in capitals and then edited; assistant messages are first
    streamed in reverse and then regenerated.  All is derived from the rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.withColumn("part", (F.row_number().over(same) - 1).cast("long"))
    step = F.ceil(F.length("text") / F.lit(pieces)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(F.col("text"), i * step + 1, step))
    none = F.lit(None).cast("string")

    def event(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    deltas = F.transform(parts, lambda p: F.struct(F.lit(DELTA).alias("kind"), p.alias("text")))
    draft = F.when(F.col("role") == "assistant", F.array(event(DELTA, F.reverse("text")), event(REGENERATE, none)))
    edited = F.when((F.col("role") != "assistant") & (F.col("turn") % 2 == 0), F.concat(F.array(event(DELTA, F.upper("text"))), F.array(event(EDIT, F.col("text")))))
    body = F.coalesce(edited, F.concat(F.coalesce(draft, F.array().cast("array<struct<kind:string,text:string>>")), deltas))
    all_ = F.concat(F.array(event(START, none)), body)
    out = rows.select("conv_id", "turn", "part", "role", F.posexplode(all_).alias("seq", "e"))
    return out.select("conv_id", "turn", "part", F.col("seq").cast("long").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


class _Fold:
    """State of the message being read."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.role = ""
        self.parts: list[str] = []

    def event(self, kind: str, role: str | None, text: str | None) -> None:
        if kind == START:
            self.role = role or ""
        elif kind == DELTA:
            self.parts.append(text or "")
        elif kind == EDIT:
            self.parts = [text or ""]
        elif kind == REGENERATE:
            self.parts = []
        else:
            raise ValueError(f"unknown event {kind!r}")

    def message(self) -> tuple[str, str]:
        return self.role, "".join(self.parts)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of sorted events: (conv_id, turn, role, text)."""
    now = _Fold()
    for batch in batches:
        done = []
        conv, turn, part, _, kind, role, text = (c.to_pylist() for c in batch.columns)
        for c, t, p, k, r, x in zip(conv, turn, part, kind, role, text):
            if now.key != (c, t, p):
                if now.key is not None:
                    done.append((*now.key, *now.message()))
                now = _Fold()
                now.key = (c, t, p)
            now.event(k, r, x)
        if done:
            yield _messages(done)
    if now.key is not None:
        yield _messages([(*now.key, *now.message())])


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    c, t, p, r, x = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(t, pa.int64()), pa.array(p, pa.int64()), pa.array(r, pa.string()), pa.array(x, pa.string())], names=["conv_id", "turn", "part", "role", "text"])


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of an event log.

    ``part`` tells messages with the same conversation and turn apart (0 if the
    log has no such column).  Messages are dealt by conversation and turn: a
    long conversation's messages are folded in many tasks.
    """
    bound_batches(events.sparkSession)
    if "part" not in events.columns:
        events = events.withColumn("part", F.lit(0).cast("long"))
    order = ["conv_id", "turn", "part", "seq", "kind", "text"]
    rows = events.select("conv_id", "turn", "part", "seq", "kind", "role", "text").repartition("conv_id", "turn", "part").sortWithinPartitions(*order)
    return rows.mapInArrow(_fold, "conv_id long, turn long, part long, role string, text string")


def format_turns(messages: DataFrame) -> DataFrame:
    """Each message with its rendered turn; a conversation's text is its turns
    in order, one after the other."""

    def render_all(batches):
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            out = [render(r or "", x or "") for r, x in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "formatted"])

    schema = T.StructType([*messages.schema.fields, T.StructField("formatted", T.StringType())])
    return messages.mapInArrow(render_all, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each conversation's rendered turns say, read back turn by turn."""
    key, state = None, None

    def result():
        n, turns, loss_n, loss, chars = state
        return (key[0], n, turns.hexdigest(), loss_n, loss.hexdigest(), chars)

    for batch in batches:
        done = []
        for c, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
            if key != (c,):
                if key is not None:
                    done.append(result())
                key, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(text.encode())
            state[4] += len(formatted)
        if done:
            yield _digests(done)
    if key is not None:
        yield _digests([result()])


def _digests(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def digest(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its rendered turns in order.

    A digest of a conversation needs its turns in order; they stream through one
    task in sorted order, one at a time."""
    rows = turns.select("conv_id", "turn", "role", "text", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "formatted").mapInArrow(_digest, schema)
