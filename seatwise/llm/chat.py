"""Chat formatting from event logs: fold a conversation's events into messages, then render them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The template. A turn is OPEN role HEAD text CLOSE.
OPEN, HEAD, CLOSE = "<s>[TURN] ", " [/TURN]\n", "</s>\n"
#: Control strings of this and of common templates. Inside texts one backslash is put after the first
#: character of each (and one more where backslashes already stand there), so that a text never has one of them, and
#: taking one backslash off gives the text back.
CONTROL = ("<s>", "</s>", "[TURN]", "[/TURN]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"
START, DELTA, EDIT, REGENERATE = "start", "delta", "edit", "regenerate"

_BODIES = "|".join(re.escape(x[1:]) for x in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_BODIES})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_BODIES})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its loss mask starts and ends (both 0 if nothing of it is learned)."""
    head = f"{OPEN}{quote(role, safe=' ')}{HEAD}"
    body = escape(text)
    learned = role == LEARNED
    return head + body + CLOSE, len(head) * learned, (len(head) + len(body)) * learned


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a turn")
    role, _, body = segment[len(OPEN) : -len(CLOSE)].partition(HEAD)
    return unquote(role), unescape(body)


def _order(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def fold(events: DataFrame) -> DataFrame:
    """The final messages of event logs: conv_id, message, role, text.

    events: conv_id, seq, kind, message (its place in the conversation), role, text. "start" opens a message with a role;
    "delta" adds its text to the message; "edit" replaces the text; "regenerate" throws the text away, and with it all
    later messages begun before, and the deltas that follow write it anew. Other kinds count as delta. Null text is empty,
    a null role is empty, a null conv_id is a conversation like any other. Ties of seq are read by kind, then text.

    Logs are partitioned by conversation and message and each message is folded in order of seq, so a very long
    conversation spreads over tasks. Only the keys of messages are then looked at conversation by conversation.
    """
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit(DELTA)).alias("kind"), "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id", "message").orderBy(*_order("seq", "kind", "text"))
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = e.withColumn("at", F.row_number().over(own)).withColumn("reset", F.coalesce(F.max(F.when(F.col("kind").isin(EDIT, REGENERATE), F.col("at"))).over(whole), F.lit(0)))
    live = F.when((F.col("at") >= F.col("reset")) & ~F.col("kind").isin(START, REGENERATE), F.struct("at", "text"))
    message = e.groupBy("conv_id", "message").agg(
        F.min(F.struct("seq", "role")).alias("first"), F.max(F.when(F.col("kind") == REGENERATE, F.col("seq"))).alias("again"),
        F.array_join(F.transform(F.array_sort(F.collect_list(live)), lambda x: x["text"]), "").alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy(*_order("message")).rowsBetween(Window.unboundedPreceding, -1)
    keys = message.withColumn("cut", F.max("again").over(earlier))
    return keys.filter(F.col("cut").isNull() | (F.col("first.seq") > F.col("cut"))).select("conv_id", "message", F.col("first.role").alias("role"), "text")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [render(role.as_py(), text.as_py()) for role, text in zip(batch.column(2), batch.column(3), strict=True)]
        arrays = [batch.column(0), batch.column(1), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64())))]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "message", "segment", "loss_start", "loss_end"])


def format_chat(events: DataFrame) -> DataFrame:
    """Rendered turns of all conversations: conv_id, message, segment, loss_start, loss_end (code points in segment).

    A conversation's formatted text is its segments in order of message; it stays in pieces, so that no row holds a whole
    conversation. See fold for the events and the defined results; an empty log gives an empty result.
    """
    messages = fold(events)
    kind = {f.name: f.dataType.simpleString() for f in messages.schema}
    return messages.mapInArrow(_rendered, f"conv_id {kind['conv_id']}, message {kind['message']}, segment string, loss_start long, loss_end long")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads turns, sorted by conversation, back one by one; holds two running digests, never a conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, open_, n, loss_n, chars, turns, loss = None, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    kind = pa.int64()

    def closed() -> tuple:
        return key, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

    for batch in batches:
        kind, rows = batch.column(0).type, []
        for conv, segment, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if not open_ or conv != key:
                if open_:
                    rows.append(closed())
                key, open_, n, loss_n, chars, turns, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, text = read_back(segment)
            masked = unescape(segment[start:end])
            turns.update(f"{role}\n{text}\n".encode())
            loss.update(masked.encode())
            n, loss_n, chars = n + 1, loss_n + len(masked), chars + len(segment)
        yield _batch(rows, kind, names)
    if open_:
        yield _batch([closed()], kind, names)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def digests(segments: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: one row of counts and digests for each."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    sorted_ = segments.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "message"))
    return sorted_.mapInArrow(_digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(turns: DataFrame) -> DataFrame:
    """The log that would have written finished turns (conv_id, turn, role, text): a start and two streamed deltas each.

    Repeated turn numbers of a conversation stay separate messages: they are numbered by turn, role, text.
    """
    text = F.coalesce("text", F.lit(""))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order("turn", "role", "text"))).cast("long")
    half = F.floor(F.char_length("text") / 2).cast("int")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).withColumn("message", number)
    event = lambda i, kind, piece: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), piece.alias("piece"))
    parts = F.array(event(0, START, F.lit("")), event(1, DELTA, F.substring("text", F.lit(1), half)), event(2, DELTA, F.substring("text", half + 1, F.char_length("text"))))
    t = t.select("conv_id", "message", "role", F.explode(parts).alias("e"))
    return t.select("conv_id", (F.col("message") * 3 + F.col("e.i")).alias("seq"), F.col("e.kind").alias("kind"), "message", "role", F.col("e.piece").alias("text"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, LEARNED, said)], turns.schema)
    return digests(format_chat(as_events(turns.unionByName(extra))))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
    regexp_replace(text, '([<\\[])(\\\\*)(s>|/s>|TURN\\]|/TURN\\]|INST\\]|/INST\\]|<SYS>>|</SYS>>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)', '\\1\\\\\\2\\3', 'g') AS escaped
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(escaped) + length(role) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
