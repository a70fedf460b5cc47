"""Operator 10: chat transcripts from an event log, with a loss mask over what the assistant says.

Events (conv_id, position, seq, kind, role, text) are sorted by conversation, position and sequence, and folded
into final messages: ``message`` opens a message at its position, ``delta`` adds to the open one, ``edit``
replaces its text, ``regenerate`` throws its text away and starts anew. Each message is rendered as one segment;
a conversation's transcript is its segments in order. The sort key holds position, so the messages of one very long
conversation are folded and rendered by many tasks; each holds one message at a time.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Control strings of this and of other common
templates inside a text get a backslash after their first character (one more, if there are some already), which
is taken away again on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, columns, materialize, read

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: What follows the first character of a control string (fixed values).
_REST = r"\|\w+\|>|/?s>|/?INST\]|</?SYS>>"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render_message(role: str, text: str) -> tuple[str, int, int]:
    """The segment, and where the text lies in it (code points)."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_message(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    if not (segment.startswith(START) and segment.endswith(END)):
        raise ValueError("not a rendered message")
    role, _, body = segment[len(START):-len(END)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return role, unescape(body)


def transcripts(events: DataFrame) -> DataFrame:
    """Rendered segments (conv_id, position, ord, formatted, loss_from, loss_to) of an event log.

    loss_from and loss_to are code points of the segment, null where the assistant doesn't speak. Within a
    conversation segments follow by position and ord.

    Defined cases: null role and text are empty, a null kind is ``message``, null positions and sequence numbers come first; events
    that tie are ordered by kind, role and text; a delta, edit or regeneration without an open message at its position
    opens one with its own role; rows of a null conv_id are one conversation; an unknown kind raises; an
    empty log gives no rows.
    """
    bounded_batches(events.sparkSession)
    by = ["conv_id", "position"]
    rank = F.when(F.col("kind") == "message", 0).otherwise(1)
    rows = columns(events, "conv_id", "position", "seq", "kind", "role", "text").select(
        "conv_id", F.col("position").cast("long").alias("position"), F.col("seq").cast("long").alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by, "seq", rank, "kind", "role", "text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, parts, order = None, "", [], 0

        def close() -> dict:
            segment, a, b = render_message(role, "".join(parts))
            speaks = role == ASSISTANT
            return {"conv_id": key[0], "position": key[1], "ord": order, "formatted": segment,
                    "loss_from": a if speaks else None, "loss_to": b if speaks else None}

        for batch in batches:
            out = []
            for e in batch.to_pylist():
                at = (e["conv_id"], e["position"])
                if key is not None and (at != key or e["kind"] == "message"):
                    out.append(close())
                    order += 1
                if at != key or e["kind"] == "message":
                    key, role, parts = at, e["role"], [e["text"]]
                elif e["kind"] == "delta":
                    parts.append(e["text"])
                elif e["kind"] in ("edit", "regenerate"):
                    parts = [e["text"]]
                else:
                    raise ValueError(f"unknown kind of event: {e['kind']}")
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=schema)

    kind = dict(rows.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", pa.int64() if kind in ("bigint", "int") else pa.string()), ("position", pa.int64()),
                        ("ord", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
    placed = placed.withColumn("conv_id", F.col("conv_id").cast("long" if kind in ("bigint", "int") else "string"))
    return placed.mapInArrow(fold, f"conv_id {'long' if kind in ('bigint', 'int') else 'string'}, position long, ord long, "
                                   "formatted string, loss_from long, loss_to long")


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what its segments hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests run over a conversation's messages in order, so a conversation is read by one task, as a stream.
    """
    kind = dict(segments.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    placed = segments.repartition("conv_id").sortWithinPartitions("conv_id", "position", "ord")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, loss, n, chars, whole, begun = None, None, None, 0, 0, 0, False
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                if not begun or s["conv_id"] != key:
                    if begun:
                        out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), whole))
                    key, turns, loss, n, chars, whole, begun = s["conv_id"], hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
                role, text = parse_message(s["formatted"])
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if s["loss_from"] is not None:
                    learned = unescape(s["formatted"][s["loss_from"]:s["loss_to"]])
                    loss.update(learned.encode("utf-8", "surrogatepass"))
                    chars += len(learned)
                n, whole = n + 1, whole + len(s["formatted"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if begun:
            row = (key, n, turns.hexdigest(), chars, loss.hexdigest(), whole)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names=names)

    types = [pa.int64() if kind == "bigint" else pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return placed.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    log = turns.union(more).select("conv_id", F.col("turn").alias("position"), F.col("turn").alias("seq"),
                                   F.lit("message").alias("kind"), "role", "text")
    return read_back(materialize(transcripts(log), "op10-segments"))


ORACLE = {"op10_chat": """
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), r as (
  select *, regexp_replace(text, '([<\\[])(\\\\*)(\\|\\w+\\|>|/?s>|/?INST\\]|</?SYS>>)', '\\1\\\\\\2\\3', 'g') as body from t
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from r group by conv_id
"""}
