"""How long turns, provider phases and steps took: performance records of two dialects.

A record keeps a native duration and the tokens of the same turn or message side by
side; ``tokens_per_second`` is only there where both belong to one successful attempt,
and ``diagnostics`` says why not.  Durations are never added or subtracted here.
Null sessions are sessions; repeated lines give repeated records; lines that are no
objects, or have no endpoint at all, give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.guards import amount, counter, stripped, token_rate
from loglattice.operators.ordered import bound, meet
from loglattice.sources.blobs import _string
from loglattice.sources.claude import field, parsed
from loglattice.sources.steps import EMPTY

#: Finishes of a message that ended.
ENDED = ("stop", "tool-calls")


def _name(path: str) -> Column:
    return F.nullif(stripped(_string(field(path, "variant"))), F.lit(""))


def _truthy(path: str) -> Column:
    return ~F.coalesce(F.to_json(field(path, "variant")), F.lit("null")).isin(*EMPTY)


def item_turns(rows: DataFrame) -> DataFrame:
    """Turns of item lines: ``session, pos, kind, turn_id, duration_ms, output_tokens, allow_rate, tokens_per_second, model, started_at, ended_at, responses, diagnostics``.

    A turn's output is the latest valid count of its own usage records; its model the last
    one a usage record names, else the first that a context names.
    """
    turn = F.coalesce(*[_name(f"$.payload.{x}") for x in ("turn_id", "turnId", "turnID")])
    number = lambda path: amount(field(path, "variant"))
    kind, inner = field("$.type"), field("$.payload.type")
    ends = (kind == "event_msg") & inner.isin("task_complete", "turn_aborted")
    context = (kind == "turn_context") | ((kind == "event_msg") & ~F.coalesce(ends, F.lit(False)))
    held = parsed(rows).filter(F.schema_of_variant(field("$.payload", "variant")).startswith("OBJECT"))
    held = bound(held.select(
        "session", "pos", turn.alias("turn_id"), (kind == "token_usage_record").alias("usage"), context.alias("context"), F.coalesce(ends, F.lit(False)).alias("ends"), (inner == "turn_aborted").alias("aborted"), _name("$.payload.model").alias("model"),
        _name("$.payload.response_id").alias("response"), counter(field("$.payload.turn_token_usage.output_tokens", "variant")).alias("output"), _truthy("$.payload.error").alias("failed"),
        number("$.payload.duration_ms").alias("duration"), field("$.payload.duration_ms", "variant").isNotNull().alias("timed"), number("$.payload.time_to_first_token_ms").alias("first"), field("$.payload.time_to_first_token_ms", "variant").isNotNull().alias("first_timed"),
        number("$.payload.started_at").alias("started"), number("$.payload.completed_at").alias("completed"),
    ))
    told = held.filter("turn_id is not null and not ends").groupBy("session", "turn_id").agg(
        F.max_by("output", F.when(F.col("usage") & F.col("output").isNotNull(), F.col("pos"))).alias("tokens"),
        F.coalesce(F.max_by("model", F.when(F.col("usage") & F.col("model").isNotNull(), F.col("pos"))), F.min_by("model", F.when(F.col("context") & F.col("model").isNotNull(), F.col("pos")))).alias("named"),
        F.count(F.when(F.col("usage"), F.col("response"))).alias("responses"),
    )
    ended = meet(held.filter("ends").drop("model", "output"), told, ["session", "turn_id"], "left")
    linked = F.col("turn_id").isNotNull()
    ended = ended.withColumns({"output": F.when(linked, F.col("tokens")), "model": F.when(linked, F.col("named")), "responses": F.when(linked, F.coalesce("responses", F.lit(0))).otherwise(0)})
    at = lambda name: F.concat(F.lit(f"{name}:line:"), F.col("pos"))
    allowed = ~F.col("aborted") & ~F.col("failed") & F.coalesce(F.col("duration") > 0, F.lit(False)) & F.col("output").isNotNull()
    why = F.array_compact(F.array(
        F.when(F.col("duration").isNull() & F.col("timed"), at("unusable_duration_ms")), F.when(~linked, at("missing_turn_id")),
        F.when(F.col("output").isNull() & ~F.col("aborted"), F.when(linked, at("missing_turn_output")).otherwise(at("unlinked_turn_output"))),
        F.when(F.col("aborted"), at("turn_aborted_no_rate")).when(F.col("failed"), at("error_bearing_no_rate")).when(F.col("duration") <= 0, at("nonpositive_duration_no_rate")),
    ))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    record = lambda kind, duration, output, allow, ended_at, responses, diagnostics: F.struct(F.lit(kind).alias("kind"), duration.alias("duration_ms"), output.alias("output_tokens"), allow.alias("allow_rate"), ended_at.cast("double").alias("ended_at"), responses.cast("long").alias("responses"), diagnostics.alias("diagnostics"))
    none = F.lit(None)
    whole = record("turn_elapsed", F.col("duration"), F.col("output"), allowed, positive("completed"), F.col("responses"), F.array_join(why, ","))
    first = record("first_output_latency", F.col("first"), none.cast("long"), F.lit(False), none, F.lit(0), F.when(F.col("first").isNull(), at("unusable_first_output_latency")).otherwise(""))
    every = F.when(F.col("first_timed"), F.array(whole, first)).otherwise(F.array(whole))
    spread = ended.select("session", "pos", "turn_id", "model", positive("started").alias("started_at"), F.explode(every).alias("r"))
    return spread.select(
        "session", "pos", "r.kind", "turn_id", "r.duration_ms", "r.output_tokens", "r.allow_rate", F.when(F.col("r.allow_rate"), token_rate(F.col("r.output_tokens"), F.col("r.duration_ms"))).alias("tokens_per_second"), "model", "started_at", "r.ended_at", "r.responses", "r.diagnostics",
    )


def message_phases(messages: DataFrame, streamed: bool = True) -> DataFrame:
    """Phases of a store's assistant messages (``session, id, data``): the provider's up to ``time.streamed`` (layouts that keep it) and the step's up to ``time.completed``.

    Records are ``session, id, kind, duration_ms, output_tokens, allow_rate, tokens_per_second, model,
    response_id, started_ms, ended_ms, diagnostics``; other roles and rows without a role of their own give none.
    """
    ms = lambda path: amount(field(path, "variant"))
    held = parsed(messages.select("session", F.col("id").alias("pos"), F.col("data").alias("raw"))).withColumnRenamed("pos", "id").filter(field("$.role") == "assistant")
    model = F.when(F.schema_of_variant(field("$.model", "variant")).startswith("OBJECT"), _name("$.model.id")).otherwise(_name("$.modelID"))
    held = bound(held.select(
        "session", "id", ms("$.time.created").alias("created"), ms("$.time.streamed").alias("streamed"), ms("$.time.completed").alias("completed"), counter(field("$.tokens.output", "variant")).alias("output"),
        model.alias("model"), _name("$.native.responseId").alias("response_id"), _truthy("$.error").alias("failed"), (field("$.retry", "variant").isNotNull() & ~F.is_variant_null(field("$.retry", "variant"))).alias("retried"), F.coalesce(field("$.finish").isin(*ENDED), F.lit(False)).alias("ended"),
    ))
    ends = [*([F.struct(F.lit("provider_phase_elapsed").alias("kind"), F.col("streamed").alias("end"))] if streamed else []), F.struct(F.lit("step_elapsed").alias("kind"), F.col("completed").alias("end"))]
    rows = held.select("*", F.inline(F.array(*ends))).filter(F.coalesce("created", "end").isNotNull())
    length = F.col("end") - F.col("created")
    cause = (
        F.when(length.isNull(), "missing_timing_no_rate").when(length < 0, "invalid_duration_no_rate").when(F.col("failed"), "error_present_no_rate").when(F.coalesce("retried", F.lit(False)), "retry_present_no_rate")
        .when(~F.col("ended"), "finish_not_terminal_no_rate").when(F.col("output").isNull(), "missing_output_tokens_no_rate").when(length <= 0, "nonpositive_duration_no_rate")
    )
    duration = F.when(length >= 0, length)
    return rows.select(
        "session", "id", "kind", duration.alias("duration_ms"), F.col("output").alias("output_tokens"), cause.isNull().alias("allow_rate"), F.when(cause.isNull(), token_rate(F.col("output"), duration)).alias("tokens_per_second"),
        "model", "response_id", F.col("created").alias("started_ms"), F.col("end").alias("ended_ms"), F.coalesce(cause, F.lit("")).alias("diagnostics"),
    )
