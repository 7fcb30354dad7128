"""Chat formatting: final messages folded from event logs, rendered under a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>"
#: Strings that have a meaning in this or in another common template.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<bos>", "<eos>",
           "<start_of_turn>", "<end_of_turn>")
#: A conversation is written in rows of about so many characters, cut between turns.
SEGMENT_CHARS = 1 << 22
#: The role whose texts are under the loss mask.
LOSS_ROLE = "assistant"

_OPENING = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|end\|>))*)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of each control string: none is left."""
    return _OPENING.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn under the template, and where its text begins and ends in it."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` of a formatted conversation; raises if it is not one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def fold(events: Iterator[tuple[str, str | None, str | None]]) -> tuple[str, str]:
    """Role and final text of one message from its ``(event, role, text)`` in sequence.

    ``open`` starts the message and names the role; ``delta`` adds to the text; ``edit`` puts
    its text in place of all so far; ``regenerate`` drops all so far. Nulls are empty; a later
    non-null role replaces the earlier; other events change nothing.
    """
    who, parts = "", []
    for event, role, text in events:
        who = role if role is not None else who
        if event in ("edit", "regenerate"):
            parts = []
        if event in ("open", "delta", "edit") and text:
            parts.append(text)
    return who, "".join(parts)


SCHEMA = "conv_id long, segment int, formatted string, loss array<struct<first: int, last: int>>, n_turns int"


def format_conversations(events: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``conv_id, segment, formatted, loss, n_turns`` from rows ``conv_id, turn, message, seq, event, role, text``.

    The log is partitioned by conversation and sorted by turn, message and sequence number,
    and each message is folded (``fold``) and rendered as its last event passes: a task holds
    one message and one segment, whatever a conversation holds. ``loss`` are the spans of
    ``formatted`` that hold the texts of the assistant, in code points. Null turns come first;
    null conversation ids are one conversation. Other columns are not used.
    """
    cols = ["conv_id", "turn", "message", "seq", "event", "role", "text"]
    log = (events.select(*cols).repartition("conv_id")
           .sortWithinPartitions("conv_id", "turn", "message", "seq", "event", "role", "text"))
    out = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()),
                     ("loss", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("n_turns", pa.int32())])

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        key, held = None, []
        for b in batches:
            for conv, turn, message, _, event, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if held and key != (conv, turn, message):
                    yield key[0], *fold(iter(held))
                    held = []
                key = (conv, turn, message)
                held.append((event, role, text))
        if held:
            yield key[0], *fold(iter(held))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, segment, parts, spans, length, held = None, 0, [], [], 0, 0

        def cut() -> None:
            rows.append((conv, segment, "".join(parts), [{"first": a, "last": b} for a, b in spans], len(parts)))
            parts.clear(), spans.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)
            rows.clear()
            return made

        for c, role, text in messages(batches):
            if parts and (c != conv or length >= segment_chars):
                cut()
                segment = segment + 1 if c == conv else 0
                held, length = held + length, 0
            elif not parts:
                segment = 0
            conv = c
            piece, first, last = render(role, text)
            if role == LOSS_ROLE:
                spans.append((length + first, length + last))
            parts.append(piece)
            length += len(piece)
            if held >= segment_chars:
                yield batch()
                held = 0
        if parts:
            cut()
        if rows:
            yield batch()

    return log.mapInArrow(in_task, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them: a row for each conversation (``DIGEST``).

    ``turns_sha256`` is over role, newline, text, newline of each turn; ``loss_chars`` and
    ``loss_sha256`` over the unescaped text under the loss mask. Segments pass one by one in
    order, and only running digests are held.
    """
    rows = (formatted.select("conv_id", "segment", "formatted", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "segment"))

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: list | None = None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for b in batches:
            for conv, _, text, loss in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and now[0] != conv:
                    done.append(row(now))
                    now = None
                now = now or [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["first"]:span["last"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if done:
                yield batch(done)
                done = []
        if now is not None:
            yield batch([row(now)])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                          [x.split()[0] for x in DIGEST.split(", ")])

    return rows.mapInArrow(in_task, DIGEST)


def events_of(conversations: DataFrame) -> DataFrame:
    """A log as a chat service writes it, whose final messages are the rows ``conv_id, turn, role, text``.

    A text comes in two deltas. Assistants also have a first draft that is dropped and
    generated anew; every third turn has a wrong text that is edited. Rows of one turn are
    told by role and text, equal ones by their row.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    event = lambda name, value: F.struct(F.lit(name).alias("event"), value.alias("text"))
    whole = F.array(event("delta", F.substring(text, F.lit(1), half)), event("delta", F.substring(text, half + 1, F.char_length(text))))
    draft = F.array(event("delta", F.reverse(text)), event("regenerate", F.lit(None).cast("string")))
    edited = F.array(event("delta", F.upper(text)), event("edit", text))
    log = F.concat(F.array(event("open", F.lit(None).cast("string"))),
                   F.when(F.col("role") == LOSS_ROLE, F.concat(draft, whole)).when(F.col("turn") % 3 == 0, edited).otherwise(whole))
    told = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    # the row's number is fixed before rows become events
    return (conversations.select("conv_id", "turn", "role", "text", F.to_json(told).alias("message"))
            .select("conv_id", "turn", "role", "message", F.posexplode(log).alias("seq", "e"))
            .select("conv_id", "turn", "message", "seq", F.col("e.event").alias("event"), "role",
                    F.col("e.text").alias("text")))
