"""Queries over durations: ``events`` become lines of turns, orders and their lines messages of a store, and intervals of two kinds overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import filters
from loglattice.operators import intervals as iv
from loglattice.sources import timing


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are usage records, views contexts and errors ends of turns of two hundred neighbouring events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.floor(F.col("event_id") / 1000).cast("string")).alias("session"), F.col("event_id").alias("pos"), "event_type")
    pos = F.col("pos")
    turn = F.when(pos % 17 != 0, F.concat(F.lit("t"), F.floor(pos / 200).cast("string"))).alias("turn_id")
    payload = lambda *columns: F.struct(*columns).alias("payload")
    name = lambda head, n: F.concat(F.lit(head), (pos % n).cast("string"))
    raw = (
        F.when(F.col("event_type") == "click", _json(F.lit("token_usage_record").alias("type"), payload(turn, F.when(pos % 3 == 0, name("r", 100)).alias("response_id"), F.when(pos % 50 == 0, name("m", 7)).alias("model"), F.struct((pos % 90).alias("output_tokens")).alias("turn_token_usage"))))
        .when(F.col("event_type") == "view", _json(F.lit("turn_context").alias("type"), payload(turn, name("c", 5).alias("model"))))
        .when(F.col("event_type") == "error", _json(F.lit("event_msg").alias("type"), payload(
            F.when(pos % 5 == 0, "turn_aborted").otherwise("task_complete").alias("type"), turn, F.when(pos % 7 == 0, "bad").alias("error"), F.when(pos % 4 != 3, pos % 60 - 5).alias("duration_ms"), F.when(pos % 2 == 0, pos % 11 - 1).alias("time_to_first_token_ms"), (pos % 3).alias("started_at"), pos.alias("completed_at"))))
        .otherwise(F.lit("[]"))
    )
    return rows.select("session", "pos", raw.alias("raw"))


def item_turn_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.item_turns(turn_lines(spark, sf_dir))


def store_phase_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    times = F.struct(F.when(key % 9 != 0, key).alias("created"), F.when(key % 5 != 0, key + key % 40 - 3).alias("streamed"), F.when(key % 7 != 0, key + key % 60).alias("completed"))
    data = _json(
        F.when(key % 11 == 0, "user").otherwise("assistant").alias("role"), times.alias("time"), F.struct(F.when(key % 13 != 0, key % 500).alias("output")).alias("tokens"), F.when(key % 4 == 0, "length").otherwise("stop").alias("finish"),
        F.when(key % 15 == 0, F.struct(F.lit("x").alias("name"))).alias("error"), F.when(key % 21 == 0, F.struct(F.lit(1).alias("attempt"))).alias("retry"), F.when(key % 2 == 0, F.concat(F.lit("m"), (key % 3).cast("string"))).alias("modelID"),
    )
    messages = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("c"), "o_custkey").alias("session"), key.alias("id"), data.alias("data"))
    return timing.message_phases(messages).select("session", F.col("id").cast("long").alias("id"), "kind", "duration_ms", "output_tokens", "allow_rate", "tokens_per_second", "model", "started_ms", "ended_ms", "diagnostics")


def tool_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user, the time that responses (clicks, an hour and more) and tools (purchases) cover together and alone."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", iv.micros("ts").alias("a"), (F.col("event_id") % 7 * iv.HOUR).alias("d"))
    spans = lambda kind: rows.filter(F.col("event_type") == kind).select("user_id", "a", (F.col("a") + F.col("d")).alias("b"))
    return iv.overlap(spans("click"), spans("purchase"), ["user_id"])


def performance_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of orders as records of turns and messages: those of one turn, and of one message by either of its ids."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    name = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    records = lines.select(pos.alias("pos"), name("t", F.col("l_linenumber")).alias("turn_id"), F.when(pos % 3 == 0, name("m", F.col("l_suppkey"))).alias("message_id"), F.when(pos % 2 == 0, name("m", F.col("l_partkey"))).alias("response_id"))
    return filters.select_performance(records, "t3").withColumn("asked", F.lit("turn")).union(filters.select_performance(records, None, "m7").withColumn("asked", F.lit("message")))


QUERIES = {f.__name__: f for f in (item_turn_timing, store_phase_timing, tool_wall, performance_selected)}

ORACLES = {
    "item_turn_timing": """
WITH e AS (SELECT 'u' || CAST(floor(event_id / 1000) AS BIGINT) AS session, event_id AS pos, event_type AS k, CASE WHEN event_id % 17 <> 0 THEN 't' || CAST(floor(event_id / 200) AS BIGINT) END AS turn_id FROM events),
t AS (SELECT session, turn_id, arg_max(pos % 90, pos) FILTER (k = 'click') AS tokens, coalesce(arg_max('m' || (pos % 7), pos) FILTER (k = 'click' AND pos % 50 = 0), arg_min('c' || (pos % 5), pos) FILTER (k = 'view')) AS model, count(*) FILTER (k = 'click' AND pos % 3 = 0) AS responses
      FROM e WHERE turn_id IS NOT NULL AND k IN ('click', 'view') GROUP BY ALL),
x AS (SELECT e.session, e.pos, e.turn_id, tokens, model, coalesce(responses, 0) AS responses, e.pos % 5 = 0 AS ab, e.pos % 7 = 0 AS er, CASE WHEN e.pos % 4 <> 3 THEN e.pos % 60 - 5 END AS rd, CASE WHEN e.pos % 2 = 0 THEN e.pos % 11 - 1 END AS rf FROM e LEFT JOIN t ON t.session = e.session AND t.turn_id = e.turn_id WHERE k = 'error'),
y AS (SELECT *, CASE WHEN rd >= 0 THEN CAST(rd AS DOUBLE) END AS d, CASE WHEN rf >= 0 THEN CAST(rf AS DOUBLE) END AS f FROM x),
z AS (SELECT *, NOT ab AND NOT er AND coalesce(d > 0, false) AND tokens IS NOT NULL AS ok FROM y)
SELECT session, pos, 'turn_elapsed' AS kind, turn_id, d AS duration_ms, tokens AS output_tokens, ok AS allow_rate, CASE WHEN ok THEN tokens * 1000 / d END AS tokens_per_second, model, CASE WHEN pos % 3 > 0 THEN CAST(pos % 3 AS DOUBLE) END AS started_at,
       CASE WHEN pos > 0 THEN CAST(pos AS DOUBLE) END AS ended_at, responses, array_to_string(list_filter([CASE WHEN d IS NULL AND rd IS NOT NULL THEN 'unusable_duration_ms:line:' || pos END, CASE WHEN turn_id IS NULL THEN 'missing_turn_id:line:' || pos END,
       CASE WHEN tokens IS NULL AND NOT ab THEN CASE WHEN turn_id IS NULL THEN 'unlinked' ELSE 'missing' END || '_turn_output:line:' || pos END,
       CASE WHEN ab THEN 'turn_aborted_no_rate:line:' || pos WHEN er THEN 'error_bearing_no_rate:line:' || pos WHEN d <= 0 THEN 'nonpositive_duration_no_rate:line:' || pos END], lambda x: x IS NOT NULL), ',') AS diagnostics FROM z
UNION ALL SELECT session, pos, 'first_output_latency', turn_id, f, NULL, false, NULL, model, CASE WHEN pos % 3 > 0 THEN CAST(pos % 3 AS DOUBLE) END, NULL, 0, CASE WHEN f IS NULL THEN 'unusable_first_output_latency:line:' || pos ELSE '' END FROM z WHERE rf IS NOT NULL
""",
    "store_phase_timing": """
WITH o AS (SELECT 'c' || o_custkey AS session, o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS c, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey + o_orderkey % 40 - 3 END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey + o_orderkey % 60 END AS d,
             CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 500 END AS n FROM orders WHERE o_orderkey % 11 <> 0),
p AS (SELECT session, id, c, n, 'provider_phase_elapsed' AS kind, CASE WHEN s >= 0 THEN s END AS e FROM o UNION ALL SELECT session, id, c, n, 'step_elapsed', d FROM o),
q AS (SELECT *, CASE WHEN c IS NULL OR e IS NULL THEN 'missing_timing_no_rate' WHEN e < c THEN 'invalid_duration_no_rate' WHEN id % 15 = 0 THEN 'error_present_no_rate' WHEN id % 21 = 0 THEN 'retry_present_no_rate' WHEN id % 4 = 0 THEN 'finish_not_terminal_no_rate'
             WHEN n IS NULL THEN 'missing_output_tokens_no_rate' WHEN e = c THEN 'nonpositive_duration_no_rate' END AS why FROM p WHERE c IS NOT NULL OR e IS NOT NULL)
SELECT session, CAST(id AS BIGINT) AS id, kind, CASE WHEN e >= c THEN CAST(e - c AS DOUBLE) END AS duration_ms, n AS output_tokens, why IS NULL AS allow_rate, CASE WHEN why IS NULL THEN n * 1000 / CAST(e - c AS DOUBLE) END AS tokens_per_second,
       CASE WHEN id % 2 = 0 THEN 'm' || (id % 3) END AS model, CAST(c AS DOUBLE) AS started_ms, CAST(e AS DOUBLE) AS ended_ms, coalesce(why, '') AS diagnostics FROM q
""",
    "tool_wall": """
WITH e AS (SELECT user_id, event_type AS k, epoch_us(ts) AS a, epoch_us(ts) + event_id % 7 * 3600000000 AS b FROM events WHERE event_id % 7 > 0 AND event_type IN ('click', 'purchase')),
s AS (SELECT user_id, t, sum(p) AS p, sum(q) AS q FROM (SELECT user_id, a AS t, (k = 'click')::INT AS p, (k = 'purchase')::INT AS q FROM e UNION ALL SELECT user_id, b, -(k = 'click')::INT, -(k = 'purchase')::INT FROM e) GROUP BY ALL),
w AS (SELECT user_id, lead(t) OVER x - t AS d, sum(p) OVER x > 0 AS p, sum(q) OVER x > 0 AS q FROM s WINDOW x AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, coalesce(sum(d) FILTER (p AND q), 0) / 1e6 AS both_seconds, coalesce(sum(d) FILTER (p AND NOT q), 0) / 1e6 AS one_seconds, coalesce(sum(d) FILTER (q AND NOT p), 0) / 1e6 AS two_seconds FROM w GROUP BY user_id
""",
    "performance_selected": """
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS pos, 't' || l_linenumber AS turn_id, CASE WHEN (l_orderkey * 10 + l_linenumber) % 3 = 0 THEN 'm' || l_suppkey END AS message_id, CASE WHEN (l_orderkey * 10 + l_linenumber) % 2 = 0 THEN 'm' || l_partkey END AS response_id FROM lineitem)
SELECT *, 'turn' AS asked FROM r WHERE turn_id = 't3' UNION ALL SELECT *, 'message' FROM r WHERE message_id = 'm7' OR response_id = 'm7'
""",
}
