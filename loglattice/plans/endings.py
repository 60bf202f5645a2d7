"""Queries over how sessions end: ``events`` become lines of two dialects, a user is a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.sources import outcomes


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), "user_id").alias("session"), F.col("event_id").alias("pos"), "event_type")


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _each(n: int, rest: int = 0) -> Column:
    return F.col("pos") % n == rest


def _id(head: str, at: Column | None = None) -> Column:
    return F.concat(F.lit(head), (F.col("pos") if at is None else at).cast("string"))


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def _part(kind: str, **values: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), *[values.get(n, F.lit(None)).cast("string").alias(n) for n in ("text", "id", "name", "tool_use_id", "content")])


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks call or speak (some of a limit) and may stop, purchases answer, views are typed or interrupt, signups queue, errors fail."""
    call = _part("tool_use", id=_id("c"), name=F.lit("Bash"))
    said = _part("text", text=F.when(_each(11), _id("You've hit your session limit ")).otherwise(_id("said ")))
    stop = F.when(_each(3), "end_turn").when(_each(3, 2), "tool_use")
    raw = (
        F.when(_is("click"), _json(F.lit("assistant").alias("type"), F.struct(F.when(_each(4), F.array(call)).otherwise(F.array(said, call)).alias("content"), stop.alias("stop_reason")).alias("message")))
        .when(_is("purchase"), _json(F.lit("user").alias("type"), F.struct(F.array(_part("tool_result", tool_use_id=_id("c", F.col("pos") - 1), content=F.lit("ok"))).alias("content")).alias("message")))
        .when(_is("view"), _json(F.lit("user").alias("type"), F.struct(F.when(_each(7), "[Request interrupted by user]").otherwise(_id("look ")).alias("content")).alias("message")))
        .when(_is("signup"), _json(F.lit("attachment").alias("type"), F.struct(F.lit("queued_command").alias("type"), _id("also ").alias("prompt"), F.struct(F.lit("human").alias("kind")).alias("origin")).alias("attachment")))
        .otherwise(_json(F.lit("system").alias("type"), F.struct(_id("lost ").alias("formatted"), F.when(_each(2), 401).alias("status")).alias("error")))
    )
    return _events(spark, sf_dir).select("session", "pos", raw.alias("raw"))


def message_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.message_outcomes(message_lines(spark, sf_dir))


def message_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.message_tags(message_lines(spark, sf_dir))


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views ask, clicks call, purchases answer, signups speak, errors close a turn in three ways."""
    payload = lambda kind, *columns: F.struct(F.lit(kind).alias("type"), *columns).alias("payload")
    raw = (
        F.when(_is("view"), _json(F.lit("response_item").alias("type"), payload("message", F.lit("user").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.when(_each(5), "<environment_context>").otherwise(_id("do ")).alias("text"))).alias("content"))))
        .when(_is("click"), _json(F.lit("response_item").alias("type"), payload("function_call", _id("c").alias("call_id"))))
        .when(_is("purchase"), _json(F.lit("response_item").alias("type"), payload("function_call_output", _id("c", F.col("pos") - 1).alias("call_id"))))
        .when(_is("signup"), _json(F.lit("event_msg").alias("type"), payload("agent_message", _id("done ").alias("message"))))
        .when(_each(3), _json(F.lit("event_msg").alias("type"), payload("task_complete")))
        .when(_each(3, 1), _json(F.lit("event_msg").alias("type"), payload("task_complete", F.struct(_id("bad ").alias("message"), F.lit("quota").alias("codex_error_info")).alias("error"))))
        .otherwise(_json(F.lit("event_msg").alias("type"), payload("turn_aborted")))
    )
    return _events(spark, sf_dir).select("session", "pos", raw.alias("raw"))


def item_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.item_outcomes(item_lines(spark, sf_dir))


QUERIES = {f.__name__: f for f in (message_outcomes, message_tags, item_outcomes)}

_EVENTS = "e AS (SELECT 'u' || user_id AS session, event_id AS pos, event_type AS k FROM events)"

ORACLES = {
    "message_outcomes": f"""
WITH {_EVENTS},
s AS (SELECT *, CASE WHEN k = 'error' THEN 'failed' WHEN k = 'view' AND pos % 7 = 0 THEN 'interrupt' WHEN k IN ('view', 'signup') THEN 'typed' WHEN k = 'click' AND pos % 4 = 0 THEN 'called' WHEN k = 'click' AND pos % 11 = 0 THEN 'limit' WHEN k = 'click' THEN 'said' END AS sym FROM e),
f AS (SELECT session, max(pos) FILTER (sym IS NOT NULL) AS spot, arg_max(sym, pos) FILTER (sym IS NOT NULL) AS sym, coalesce(arg_max(sym, pos) FILTER (sym IN ('said', 'limit')) = 'limit', false) AS lim FROM s GROUP BY session),
o AS (SELECT DISTINCT a.session FROM e a LEFT JOIN e b ON a.session = b.session AND b.k = 'purchase' AND b.pos - 1 = a.pos WHERE a.k = 'click' AND a.pos % 4 = 0 AND b.pos IS NULL),
r AS (SELECT f.session, spot, CASE WHEN sym = 'failed' THEN 'error' WHEN sym = 'interrupt' THEN 'interrupt' WHEN sym = 'typed' THEN 'pending' WHEN lim THEN 'limit' WHEN sym IS NULL THEN 'none' WHEN o.session IS NULL THEN 'done' ELSE 'open' END AS st, sym FROM f LEFT JOIN o USING (session))
SELECT session, CASE WHEN st IN ('error', 'interrupt', 'limit') THEN 'aborted' WHEN st IN ('pending', 'done') THEN st ELSE 'unknown' END AS status, spot AS at,
       CASE WHEN st IN ('error', 'limit') THEN 'provider' WHEN st = 'interrupt' THEN 'aborted' END AS error_kind,
       CASE WHEN st = 'error' THEN 'lost ' || spot WHEN st = 'interrupt' THEN '[Request interrupted by user]' WHEN st = 'limit' AND sym = 'limit' THEN 'You''ve hit your session limit ' || spot END AS error,
       CASE WHEN st = 'error' AND spot % 2 = 0 THEN '401' END AS code FROM r
""",
    "message_tags": f"""
WITH {_EVENTS},
s AS (SELECT *, CASE WHEN k = 'error' THEN 'failed' WHEN k = 'view' AND pos % 7 = 0 THEN 'failed' WHEN k IN ('view', 'signup') THEN 'typed' WHEN k = 'click' AND pos % 4 = 0 THEN NULL WHEN k = 'click' AND pos % 11 = 0 THEN 'failed' WHEN k = 'click' AND pos % 3 = 2 THEN 'more' WHEN k = 'click' THEN 'end' END AS sym FROM e),
f AS (SELECT session, max(pos) FILTER (sym IS NOT NULL) AS spot, arg_max(sym, pos) FILTER (sym IS NOT NULL) AS sym FROM s GROUP BY session),
n AS (SELECT f.session, spot, f.sym, min(s.pos) AS nxt FROM f LEFT JOIN s ON s.session = f.session AND s.pos > spot GROUP BY ALL)
SELECT session, CASE WHEN sym = 'failed' THEN '⚠️已中断' WHEN sym = 'typed' THEN '⏳待回复' WHEN sym = 'end' AND nxt IS NULL THEN '✅已完成' ELSE '' END AS tag, CASE WHEN sym = 'end' AND nxt IS NOT NULL THEN nxt ELSE spot END AS at FROM n
""",
    "item_outcomes": f"""
WITH {_EVENTS},
s AS (SELECT *, CASE WHEN k = 'view' AND pos % 5 <> 0 THEN 'user' WHEN k = 'signup' THEN 'agent' WHEN k = 'error' THEN ['complete', 'failed', 'aborted'][pos % 3 + 1] END AS sym FROM e),
f AS (SELECT session, max(pos) FILTER (sym IS NOT NULL) AS spot, arg_max(sym, pos) FILTER (sym IS NOT NULL) AS sym, coalesce(max(pos) FILTER (sym IN ('user', 'complete', 'failed', 'aborted')), -1) AS closed FROM s GROUP BY session),
t AS (SELECT f.session, min(e.pos) AS tool FROM f JOIN e ON e.session = f.session AND e.pos > spot AND k IN ('click', 'purchase') GROUP BY ALL),
o AS (SELECT DISTINCT a.session FROM e a JOIN f ON f.session = a.session LEFT JOIN e b ON a.session = b.session AND b.k = 'purchase' AND b.pos - 1 = a.pos AND b.pos > closed WHERE a.k = 'click' AND a.pos > closed AND b.pos IS NULL),
r AS (SELECT f.session, CASE WHEN sym IN ('complete', 'failed', 'aborted') AND tool IS NOT NULL THEN tool ELSE spot END AS place,
             CASE WHEN sym IN ('complete', 'failed', 'aborted') AND tool IS NOT NULL THEN 'working' ELSE sym END AS st, o.session IS NOT NULL AS open FROM f LEFT JOIN t USING (session) LEFT JOIN o ON o.session = f.session)
SELECT session, CASE WHEN st IN ('failed', 'aborted') THEN 'aborted' WHEN st = 'complete' THEN 'done' WHEN st = 'user' AND NOT open THEN 'pending' WHEN st = 'agent' AND NOT open THEN 'done' ELSE 'unknown' END AS status, place AS at,
       CASE st WHEN 'aborted' THEN 'aborted' WHEN 'failed' THEN 'provider' END AS error_kind, CASE st WHEN 'aborted' THEN 'turn_aborted' WHEN 'failed' THEN 'bad ' || place END AS error, CASE st WHEN 'failed' THEN 'quota' END AS code FROM r
""",
}
