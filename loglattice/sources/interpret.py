"""From native lines to the one event log: flat dialects as plain projections.

Each function takes ``session, pos, raw`` and returns the events of
:mod:`loglattice.operators.turns` (``session, seq, type, text, origin, call_id,
turn_id, error_kind, stop_reason``) with dense ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.guards import label, native
from loglattice.functions.text import classify_error
from loglattice.operators.ordered import carry_forward, drop_repeats, numbered_within, running_sum
from loglattice.operators.relations import active_branch

_PART = "array<struct<type:string,text:string,thinking:string,id:string,name:string>>"
EVENT = ("session", "pos", "sub", "type", "text", "origin", "call_id", "turn_id", "error_kind", "stop_reason")


def _text(path: str) -> Column:
    return label(native("raw", path))


def _none() -> Column:
    return F.lit(None).cast("string")


def _numbered(rows: DataFrame) -> DataFrame:
    """Dense ``seq`` from 1 by line and place within the line."""
    return numbered_within(rows, ["session"], "pos", "sub", "seq").select("session", "seq", *[c for c in EVENT if c not in ("session", "pos", "sub")])


def _parts(raw_path: str) -> Column:
    """Content as an array of parts; a plain string is one text part."""
    value = F.get_json_object("raw", raw_path)
    plain = F.array(F.struct(F.lit("text").alias("type"), value.alias("text"), _none().alias("thinking"), _none().alias("id"), _none().alias("name")))
    return F.when(value.startswith("["), F.from_json(value, _PART)).when(value.isNotNull(), plain.cast(_PART))


def pi_events(rows: DataFrame) -> DataFrame:
    """Messages on the active branch of a tree of lines."""
    entries = rows.select("session", "pos", "raw", _text("$.type").alias("kind"), _text("$.id").alias("id"), _text("$.parentId").alias("parent_id"))
    branch = active_branch(entries.filter("kind <> 'session'")).filter("kind = 'message'")
    role = _text("$.message.role")
    parts = F.when(role == "toolResult", F.lit(None).cast(_PART)).otherwise(_parts("$.message.content"))
    spread = branch.select("session", "pos", "raw", role.alias("role"), F.posexplode_outer(parts).alias("sub", "part"))
    kind = (
        F.when(F.col("role") == "toolResult", "tool_result").when(F.col("role") == "user", "user_message")
        .when(F.col("part.type") == "toolCall", "tool_call").when(F.col("part.type") == "thinking", "thinking").otherwise("assistant_message")
    )
    failure = _text("$.message.errorMessage")
    body = F.when(F.col("role") == "toolResult", F.get_json_object("raw", "$.message.content")).otherwise(F.coalesce("part.text", "part.thinking", "part.name"))
    return _numbered(
        spread.select(
            "session", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), kind.alias("type"), body.alias("text"), _none().alias("origin"),
            F.when(F.col("role") == "toolResult", _text("$.message.toolCallId")).otherwise(F.col("part.id")).alias("call_id"), _none().alias("turn_id"),
            F.when(failure.isNotNull(), classify_error(_text("$.message.stopReason"), _none(), failure)["error_kind"]).alias("error_kind"), _text("$.message.stopReason").alias("stop_reason"),
        )
    )


def codex_events(rows: DataFrame) -> DataFrame:
    """Response items and event messages; a turn id stays until the next one, equal neighbours count once."""
    kind, inner = _text("$.type"), _text("$.payload.type")
    turned = carry_forward(rows, ["session"], "pos", _text("$.payload.turn_id"), "turn_id")
    role = _text("$.payload.role")
    message = (kind == "response_item") & (inner == "message")
    note = kind == "event_msg"
    type_ = (
        F.when(message & (role == "user"), "user_message").when(message & (role == "assistant"), "assistant_message")
        .when(note & (inner == "user_message"), "user_message").when(note & (inner == "agent_message"), "assistant_message")
        .when(inner.isin("function_call", "custom_tool_call"), "tool_call").when(inner.isin("function_call_output", "custom_tool_call_output"), "tool_result")
        .when(inner == "reasoning", "thinking").when(note & inner.isin("task_complete", "turn_aborted"), "lifecycle").when(kind == "compacted", "compaction")
    )
    joined = F.array_join(F.transform(_parts("$.payload.content"), lambda x: x["text"]), "\n")
    body = F.when(message, joined).when(type_ == "lifecycle", inner).otherwise(F.coalesce(_text("$.payload.message"), F.get_json_object("raw", "$.payload.output"), _text("$.payload.name")))
    failure = F.get_json_object("raw", "$.payload.error")
    events = turned.select(
        "session", "pos", F.lit(0).alias("sub"), type_.alias("type"), body.alias("text"), _none().alias("origin"), _text("$.payload.call_id").alias("call_id"), "turn_id",
        F.when(failure.isNotNull(), classify_error(_none(), _none(), failure)["error_kind"]).alias("error_kind"), _text("$.payload.reason").alias("stop_reason"),
    ).filter("type IS NOT NULL")
    said = F.col("type").isin("user_message", "assistant_message")
    marked = events.withColumn("_t", F.when(said, F.col("text")).otherwise(F.col("pos").cast("string")))
    return _numbered(drop_repeats(marked, ["session"], "pos", ["type", "_t"]))


def kimi_events(rows: DataFrame) -> DataFrame:
    """Messages, loop parts, tool calls and results."""
    kind, inner = _text("$.type"), _text("$.event.type")
    part = _text("$.event.part.type")
    type_ = (
        F.when((kind == "context.append_message") & (_text("$.message.role") == "user"), "user_message")
        .when((inner == "content.part") & (part == "think"), "thinking").when(inner == "content.part", "assistant_message").when(inner == "tool.call", "tool_call").when(inner == "tool.result", "tool_result")
        .when(kind == "turn.ended", "lifecycle")
    )
    said = F.array_join(F.transform(_parts("$.message.content"), lambda x: x["text"]), "\n")
    body = F.when(type_ == "user_message", said).when(type_ == "lifecycle", F.coalesce(_text("$.reason"), F.lit("completed"))).otherwise(F.coalesce(_text("$.event.part.text"), _text("$.event.part.think"), _text("$.event.name"), F.get_json_object("raw", "$.event.result")))
    injected = F.when(_text("$.message.origin.kind").isNotNull() & (_text("$.message.origin.kind") != "user"), "injected")
    return _numbered(
        rows.select(
            "session", "pos", F.lit(0).alias("sub"), type_.alias("type"), body.alias("text"), F.when(type_ == "user_message", injected).alias("origin"),
            F.coalesce(_text("$.event.toolCallId"), _text("$.event.id")).alias("call_id"), F.coalesce(_text("$.event.turnId"), _text("$.turnId")).alias("turn_id"), _none().alias("error_kind"), _text("$.reason").alias("stop_reason"),
        ).filter("type IS NOT NULL")
    )


def merged_assistant(events: DataFrame) -> DataFrame:
    """Conversation in which neighbouring assistant pieces are one message, parted by a blank line."""
    said = events.filter(F.col("type").isin("user_message", "assistant_message") & F.col("text").rlike(r"\S"))
    near = Window.partitionBy("session").orderBy("seq")
    opens = F.when((F.col("type") == "assistant_message") & F.coalesce(F.lag("type").over(near) == "assistant_message", F.lit(False)), 0).otherwise(1)
    numbered = running_sum(said.withColumn("_n", opens), ["session"], "seq", F.col("_n"), "message")
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n")
    return numbered.groupBy("session", "message").agg(F.min("seq").alias("seq"), F.first("type").alias("type"), pieces.alias("text"))
