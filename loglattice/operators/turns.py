"""Turns, outcomes, tool-call pairs and conversation views of an event log.

An event log has ``session, seq, type, text, origin, call_id, turn_id,
error_kind, stop_reason``; ``seq`` orders a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators.ordered import drop_repeats, meet, running_sum

AGENT_SIDE = ("assistant_message", "thinking", "tool_call", "tool_result")
#: The status of a session by that of its last turn.
SESSION_STATUS = {"completed": "done", "awaiting_input": "pending", "in_progress": "pending", "failed": "aborted", "interrupted": "aborted", "rejected": "unknown", "unknown": "unknown"}


def with_turn_index(events: DataFrame) -> DataFrame:
    """Events with ``turn_index``: every user message opens a turn, unless nothing came before it."""
    user = F.when(F.col("type") == "user_message", 1).otherwise(0)
    firsts = events.groupBy("session").agg(F.min_by(user, "seq").alias("_first"))
    counted = running_sum(events, ["session"], "seq", user, "turn_index")
    return counted.join(firsts, "session").withColumn("turn_index", F.col("turn_index") - F.col("_first")).drop("_first")


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("seq")))


def turns(events: DataFrame) -> DataFrame:
    """One row for each turn: bounds, id, status and what the status rests on.

    A turn fails only by an error without clean agent content after it; a
    trailing lifecycle mark, a trailing user message and unanswered calls come
    next, in that order.
    """
    marked = with_turn_index(events)
    error = F.col("error_kind").isNotNull()
    agent = F.col("type").isin(*AGENT_SIDE)
    life = F.col("type") == "lifecycle"
    call, result, unkeyed = F.col("type") == "tool_call", F.col("type") == "tool_result", F.coalesce(F.col("call_id"), F.lit("")) == ""
    spans = marked.groupBy("session", "turn_index").agg(
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("event_count"),
        F.when(F.min("turn_id") == F.max("turn_id"), F.min("turn_id")).alias("native_id"),
        F.max(F.when(error, F.col("seq"))).alias("error_seq"), F.max(F.when(~error & agent, F.col("seq"))).alias("clean_seq"), F.max(F.when(life, F.col("seq"))).alias("life_seq"),
        _last(F.col("error_kind"), error).alias("last_error"), _last(F.lower(F.trim(F.coalesce("text", F.lit("")))), life).alias("life_text"),
        _last(F.col("stop_reason"), F.col("stop_reason").isNotNull()).alias("stop_reason"), F.max_by("type", "seq").alias("last_type"),
        F.bool_or(agent | life).alias("agent_side"), F.max(F.when(F.col("type") == "user_message", F.col("seq"))).alias("user_seq"),
        (F.count_if(call & unkeyed) > F.count_if(result & unkeyed)).alias("open_unkeyed"),
    )
    keyed = marked.filter((call | result) & ~unkeyed).groupBy("session", "turn_index", "call_id").agg(F.bool_or(result).alias("answered"))
    opened = keyed.filter(~F.col("answered")).groupBy("session", "turn_index").agg(F.count(F.lit(1)).alias("n_open"))
    lasts = spans.groupBy("session").agg(F.max("turn_index").alias("last_index"))
    spans = spans.join(opened, ["session", "turn_index"], "left").join(lasts, "session")
    none = F.lit(-1)
    errors, clean = F.coalesce("error_seq", none), F.coalesce("clean_seq", none)
    is_last = F.col("turn_index") == F.col("last_index")
    marker = F.coalesce("life_seq", none) > F.greatest(errors, clean)
    says = lambda *words: F.col("life_text").rlike("|".join(words))
    status = (
        F.when((errors >= 0) & (errors > clean), F.when(F.col("last_error") == "user_interrupt", "interrupted").otherwise("failed"))
        .when(marker, F.when(says("abort", "cancel"), "interrupted").when(says("complete", "finish", "stop"), "completed").otherwise("unknown"))
        .when(is_last & (F.col("last_type") == "user_message"), "in_progress")
        .when(F.col("agent_side"), F.when(is_last & (F.col("open_unkeyed") | F.col("n_open").isNotNull()), "unknown").otherwise("completed"))
        .when(~is_last, "unknown")
        .otherwise("in_progress")
    )
    name = F.coalesce("native_id", F.format_string("turn-%04d", "turn_index"))
    return spans.select("session", "turn_index", name.alias("turn_id"), "start_seq", "end_seq", "user_seq", "event_count", status.alias("status"), "stop_reason", F.when(errors > clean, F.col("last_error")).alias("error_kind"))


def session_outcomes(turn_rows: DataFrame) -> DataFrame:
    """``session, n_turns, status``: the last turn decides."""
    table = F.create_map(*[F.lit(x) for pair in SESSION_STATUS.items() for x in pair])
    last = turn_rows.groupBy("session").agg(F.count(F.lit(1)).alias("n_turns"), F.max_by("status", "turn_index").alias("last"))
    return last.select("session", "n_turns", F.coalesce(F.try_element_at(table, F.col("last")), F.lit("unknown")).alias("status"))


def visible_in_conversation(include_errors: bool = False) -> Column:
    """User and assistant messages with text; injected ones and mere error reports are hidden."""
    shown = F.col("type").isin("user_message", "assistant_message") & F.col("text").rlike(r"\S")
    shown = shown & ~F.coalesce(F.col("origin") == "injected", F.lit(False))
    return shown if include_errors else shown & ~((F.col("type") == "assistant_message") & F.col("error_kind").isNotNull())


def conversation(events: DataFrame, include_errors: bool = False) -> DataFrame:
    return events.filter(visible_in_conversation(include_errors)).select("session", "seq", F.when(F.col("type") == "user_message", "user").otherwise("assistant").alias("role"), "text")


def compact_view(events: DataFrame) -> DataFrame:
    """Events without compaction, lifecycle and injected user rows, renumbered densely as ``view_seq``."""
    injected = (F.col("type") == "user_message") & F.coalesce(F.col("origin") == "injected", F.lit(False))
    kept = events.filter(~F.col("type").isin("compaction", "lifecycle") & ~injected)
    return running_sum(kept, ["session"], "seq", F.lit(1), "view_seq").select("session", "seq", "view_seq", "type", "text")


def tail(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` messages of every session; places are counted in buckets, so no task sorts a session."""
    total = messages.groupBy("session").agg(F.count(F.lit(1)).alias("_n"))
    placed = meet(running_sum(messages, ["session"], "seq", F.lit(1), "_r"), total, ["session"])
    return placed.filter(F.col("_r") > F.col("_n") - n).drop("_r", "_n")


def loop_counts(events: DataFrame) -> DataFrame:
    """``session, loops``: rising edges, i.e. agent messages that don't follow an agent message; sessions without messages have no row."""
    sides = events.filter(F.col("type").isin("user_message", "assistant_message")).select("session", "seq", "type")
    return drop_repeats(sides, ["session"], "seq", ["type"]).groupBy("session").agg(F.count_if(F.col("type") == "assistant_message").alias("loops"))


def event_counts(events: DataFrame, types: tuple[str, ...] = ("user_message", "assistant_message", "thinking", "tool_call", "tool_result")) -> DataFrame:
    """One column for each type, zero where a session has none."""
    return events.groupBy("session").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types])


def invocation_status(call: Column, result_status: Column, output: Column) -> Column:
    """The status of a call by its result."""
    slow = F.lower(F.coalesce(output, F.lit(""))).rlike("timed out|timeout|deadline exceeded")
    failed = F.when(slow, "timed_out").otherwise("failed")
    return F.when(call.isNull(), "orphan").when(result_status.isNull(), "proposed").when(result_status == "pending", "awaiting_approval").when(result_status.isin("denied", "declined"), "denied").when(result_status == "ok", "succeeded").when(result_status == "error", failed).otherwise("unknown")


def pair_by_id(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Full outer pairing of calls and results whose ids are unique within a session.

    ``calls(session, call_id, call_seq)``, ``results(session, call_id, result_seq, result_status, output)``.
    """
    both = calls.join(results, ["session", "call_id"], "full_outer")
    return both.withColumn("status", invocation_status(F.col("call_seq"), F.col("result_status"), F.col("output"))).drop("output")
