"""Queries over native lines: events become the lines of session files, which the interpreters and collectors read.

A user is a session and an event id the number of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import conformance
from loglattice.plans.dialogue import activity
from loglattice.sources import claude, collect, parts


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
    names = ("text", "thinking", "id", "name", "tool_use_id", "content", "is_error")
    return F.struct(F.lit(kind).alias("type"), *[values.get(n, F.lit(None)).cast("boolean" if n == "is_error" else "string").alias(n) for n in names])


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are typed lines, clicks an assistant's, purchases tool results, signups queued commands, errors upstream errors."""
    typed = F.when(_each(7), F.lit("<local-command-stdout>x")).when(_each(11), F.lit("[Request interrupted by user]")).otherwise(_id(" look at "))
    spoken = F.array(_part("thinking", thinking=F.lit("hm")), _part("text", text=F.when(_each(3), " ").otherwise(_id("saw "))), _part("tool_use", id=_id("c"), name=F.lit("Bash")))
    output = F.when(_each(3), F.lit("")).when(_each(3, 1), F.lit("fine\nError: no")).otherwise(F.lit("fine"))
    result = _part("tool_result", tool_use_id=_id("c", F.col("pos") - 1), content=output, is_error=F.when(_each(5), F.lit(True)))
    results = F.when(_each(4), F.array(result, _part("text", text=_id("and ")))).otherwise(F.array(result))
    raw = (
        F.when(_is("view"), _json(F.lit("user").alias("type"), F.struct(typed.alias("content")).alias("message")))
        .when(_is("click"), _json(F.lit("assistant").alias("type"), _each(13).alias("isSidechain"), F.struct(_id("m").alias("id"), spoken.alias("content")).alias("message")))
        .when(_is("purchase"), _json(F.lit("user").alias("type"), F.struct(results.alias("content")).alias("message")))
        .when(_is("signup"), _json(F.lit("attachment").alias("type"), F.struct(F.lit("queued_command").alias("type"), _id("also ").alias("prompt"), F.struct(F.when(_each(3), "task").otherwise("human").alias("kind")).alias("origin")).alias("attachment")))
        .otherwise(_json(F.lit("system").alias("type"), F.struct(F.when(_each(2), "401 API key is invalid.").otherwise("Connection dropped").alias("formatted"), F.when(_each(2), 401).alias("status")).alias("error")))
    )
    return _events(spark, sf_dir).select("session", "pos", raw.alias("raw"))


def message_line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claude.events(message_lines(spark, sf_dir))


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks carry usage, a model or labels only; errors are cost states of two models."""
    usage = F.struct((F.col("pos") % 100).alias("input_tokens"), F.when(~_each(7), F.col("pos") % 9).alias("output_tokens"), F.struct(F.col("pos") % 5).alias("output_tokens_details").cast("struct<thinking_tokens:long>").alias("output_tokens_details"))
    model = F.when(_each(4), F.lit(None)).otherwise(_id("model-", F.col("pos") % 3))
    bucket = lambda n: F.struct((F.col("pos") % n).alias("inputTokens"), (F.col("pos") % 8 / 4).alias("costUSD"))
    raw = (
        F.when(_is("click"), _json(F.lit("assistant").alias("type"), F.when(_each(5), " want ").alias("requestedModel"), F.struct(_id("m", F.floor(F.col("pos") / 3)).alias("id"), model.alias("model"), F.when(~_each(6), usage).alias("usage")).alias("message")))
        .when(_is("error"), _json(F.lit("cost-state").alias("type"), F.col("session").alias("sessionId"), F.struct(bucket(10).alias("a"), bucket(3).alias("b")).alias("modelUsage")))
        .otherwise(_json(F.lit("user").alias("type"), F.struct(F.lit("hi").alias("content")).alias("message")))
    )
    return _events(spark, sf_dir).select("session", "pos", raw.alias("raw"))


_SHOWN = ("session", "observation_id", "scope", "counter", "scope_id", "response_id", "turn_id", "model", "requested_model", "input_tokens", "output_tokens", "reasoning_tokens", "cost")


def message_line_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.claude_observations(usage_lines(spark, sf_dir)).select(*_SHOWN)


def item_usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are turn contexts, clicks usage records of three kinds, purchases notes of a count."""
    turn = _id("t", F.floor(F.col("pos") / 40))
    tokens = lambda n: F.struct((F.col("pos") % n).alias("input_tokens"), F.lit(2).alias("output_tokens"))
    payload = lambda *columns: F.struct(*columns).alias("payload")
    raw = (
        F.when(_is("view"), _json(F.lit("turn_context").alias("type"), payload(turn.alias("turn_id"), F.when(~_each(3), _id("ask-", F.col("pos") % 4)).alias("model"))))
        .when(_is("click"), _json(F.lit("token_usage_record").alias("type"), payload(turn.alias("turn_id"), _id("r").alias("response_id"), F.lit("th").alias("thread_id"), F.when(_each(5), "own").alias("model"), tokens(10).alias("usage"), F.when(_each(2), tokens(20)).alias("turn_token_usage"), F.when(_each(3), tokens(30)).alias("thread_token_usage"))))
        .when(_is("purchase"), _json(F.lit("event_msg").alias("type"), payload(F.lit("token_count").alias("type"), F.struct(tokens(7).alias("last_token_usage")).alias("info"))))
        .otherwise(F.lit("[]"))
    )
    return _events(spark, sf_dir).select("session", "pos", raw.alias("raw"))


def item_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.codex_observations(item_usage_lines(spark, sf_dir)).select(*_SHOWN)


def _stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders are messages of their customer and lines their parts; a fifth of the orders have no parts."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    key, line = F.col("o_orderkey"), F.col("l_linenumber")
    error = F.struct(F.when(key % 2 == 0, "MessageAbortedError").otherwise("APIError").alias("name"), F.struct(F.lit("gone wrong").alias("message"), F.when(key % 2 != 0, 429).alias("statusCode")).alias("data"))
    data = _json(F.when(key % 3 == 0, "user").otherwise("assistant").alias("role"), F.when(key % 7 == 0, "stop").alias("finish"), F.when((key % 4 == 1) & (key % 3 != 0), error).alias("error"))
    messages = orders.select(F.concat(F.lit("c"), "o_custkey").alias("session"), F.concat(F.lit("o"), F.lpad(key.cast("string"), 9, "0")).alias("id"), (key * 5 % 1000).alias("created"), data.alias("data"))
    state = F.struct(F.when(line % 3 == 0, "error").when(line % 3 == 1, "completed").otherwise("running").alias("status"), F.lit("out").alias("output"), F.lit("bad").alias("error"))
    part = (
        F.when((F.col("l_orderkey") + line) % 4 == 0, _json(F.lit("text").alias("type"), F.when(line % 5 == 0, " ").otherwise(F.concat(F.lit(" t"), line.cast("string"))).alias("text"), (line == 3).alias("synthetic")))
        .when((F.col("l_orderkey") + line) % 4 == 1, _json(F.lit("reasoning").alias("type"), F.lit("hm").alias("text"))).when((F.col("l_orderkey") + line) % 4 == 2, _json(F.lit("tool").alias("type"), F.lit("bash").alias("tool"), F.concat(F.lit("k"), line.cast("string")).alias("callID"), state.alias("state")))
        .otherwise(_json(F.lit("step-start").alias("type")))
    )
    lines = lines.filter("l_orderkey % 5 <> 0").select("l_orderkey", "l_linenumber").distinct()  # all of a part is made of these
    parts = lines.select(F.concat(F.lit("o"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("message_id"), F.concat(F.lit("p"), line.cast("string")).alias("id"), F.lit(0).alias("created"), part.alias("data"))
    return messages, parts


def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.events(*_stores(spark, sf_dir))


def store_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.conversation(*_stores(spark, sf_dir))


def conformance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the log of events breaks, by number: its ids don't count from 1, and results stand before their calls."""
    log = activity(spark, sf_dir)
    found = conformance.sequence(log).union(conformance.pairing(log))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("n_sessions"))


QUERIES = {f.__name__: f for f in (message_line_events, message_line_usage, item_usage, store_events, store_conversation, conformance_report)}

_E = "e AS (SELECT 'u' || user_id AS session, event_id AS pos, event_type FROM events)"

ORACLES = {
    "message_line_events": f"""WITH {_E},
        l AS (SELECT *, CASE WHEN event_type = 'view' AND pos % 7 <> 0 AND pos % 11 <> 0 THEN 'look at ' || pos WHEN event_type = 'purchase' AND pos % 4 = 0 THEN 'and ' || pos WHEN event_type = 'signup' AND pos % 3 <> 0 THEN 'also ' || pos END AS typed,
              CASE WHEN event_type = 'error' THEN CASE WHEN pos % 2 = 0 THEN '401 API key is invalid.' ELSE 'Connection dropped' END END AS failure, event_type = 'click' AND pos % 13 <> 0 AS live FROM e),
        m AS (SELECT *, CASE WHEN failure IS NOT NULL THEN pos WHEN typed IS NOT NULL OR (live AND pos % 3 <> 0) THEN -1 END AS mark FROM l),
        p AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending FROM m),
        x AS (SELECT session, max_by(mark, pos) AS mark FROM m WHERE mark IS NOT NULL GROUP BY session),
        o AS (
          SELECT session, pos, 0 AS sub, 'tool_result' AS type, CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN 'fine' || chr(10) || 'Error: no' ELSE 'fine' END AS text, NULL AS origin, 'c' || (pos - 1) AS call_id, NULL AS message_id, NULL AS name,
                 CASE WHEN pos % 5 = 0 THEN 'error' WHEN pos % 3 = 0 THEN 'unknown' WHEN pos % 3 = 1 THEN 'error' ELSE 'ok' END AS result_status, NULL AS err FROM p WHERE event_type = 'purchase'
          UNION ALL SELECT session, pos, 1, 'assistant_message', NULL, NULL, NULL, NULL, NULL, NULL, pending FROM p WHERE typed IS NOT NULL AND pending >= 0
          UNION ALL SELECT session, pos, 2, 'user_message', typed, CASE WHEN event_type = 'signup' THEN 'human' END, NULL, NULL, NULL, NULL, NULL FROM p WHERE typed IS NOT NULL
          UNION ALL SELECT session, pos, 3, 'user_message', '<local-command-stdout>x', 'injected', NULL, NULL, NULL, NULL, NULL FROM p WHERE event_type = 'view' AND pos % 7 = 0
          UNION ALL SELECT session, pos, 4, 'thinking', 'hm', NULL, NULL, 'm' || pos, NULL, NULL, NULL FROM p WHERE live
          UNION ALL SELECT session, pos, 5, 'assistant_message', 'saw ' || pos, NULL, NULL, 'm' || pos, NULL, NULL, NULL FROM p WHERE live AND pos % 3 <> 0
          UNION ALL SELECT session, pos, 6, 'tool_call', NULL, NULL, 'c' || pos, NULL, 'Bash', NULL, NULL FROM p WHERE live
          UNION ALL SELECT session, 4611686018427387904, 0, 'assistant_message', NULL, NULL, NULL, NULL, NULL, NULL, mark FROM x WHERE mark >= 0)
        SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY pos, sub) AS BIGINT) AS seq, type, CASE WHEN err IS NULL THEN text WHEN err % 2 = 0 THEN '401 API key is invalid.' ELSE 'Connection dropped' END AS text, origin, call_id, message_id, name, result_status,
               CASE WHEN err % 2 = 0 THEN '401' END AS error_code, CASE WHEN err % 2 = 0 THEN 'auth' WHEN err IS NOT NULL THEN 'provider_error' END AS error_kind, CASE WHEN err % 2 = 0 THEN FALSE WHEN err IS NOT NULL THEN TRUE END AS retryable FROM o""",
    "message_line_usage": f"""WITH {_E},
        c AS (SELECT *, pos % 4 = 0 AS bare, pos % 6 = 0 AS unused FROM e WHERE event_type = 'click')
        SELECT session, 'claude:' || session || ':line:' || pos || CASE WHEN bare AND unused THEN ':attribution' ELSE ':usage' END AS observation_id, CASE WHEN bare AND unused THEN 'unknown' ELSE 'message' END AS scope, CASE WHEN bare AND unused THEN 'unknown' ELSE 'absolute' END AS counter,
               'm' || (pos // 3) AS scope_id, 'm' || (pos // 3) AS response_id, CAST(NULL AS VARCHAR) AS turn_id, CASE WHEN NOT bare THEN 'model-' || (pos % 3) END AS model, CASE WHEN pos % 5 = 0 THEN 'want' END AS requested_model,
               CASE WHEN NOT unused THEN pos % 100 END AS input_tokens, CASE WHEN NOT unused AND pos % 7 <> 0 THEN pos % 9 END AS output_tokens, CASE WHEN NOT unused THEN pos % 5 END AS reasoning_tokens, CAST(NULL AS DOUBLE) AS cost
        FROM c WHERE NOT (bare AND unused) OR pos % 5 = 0
        UNION ALL SELECT session, 'claude:' || session || ':line:' || pos || ':modelUsage:' || m, 'session', 'cumulative', session, NULL, NULL, m, NULL, pos % n, NULL, NULL, (pos % 8)::DOUBLE / 4 FROM e, (VALUES ('a', 10), ('b', 3)) v(m, n) WHERE event_type = 'error'""",
    "item_usage": f"""WITH {_E},
        t AS (SELECT session, 't' || (pos // 40) AS turn_id, arg_max('ask-' || (pos % 4), pos) AS asked FROM e WHERE event_type = 'view' AND pos % 3 <> 0 GROUP BY 1, 2),
        u AS (SELECT session, pos, 'usage' AS f, 'call' AS scope, 'absolute' AS counter, 'r' || pos AS response_id, 't' || (pos // 40) AS turn_id, 'r' || pos AS scope_id, pos % 10 AS i, CASE WHEN pos % 5 = 0 THEN 'own' END AS model FROM e WHERE event_type = 'click'
          UNION ALL SELECT session, pos, 'turn_token_usage', 'turn', 'cumulative', 'r' || pos, 't' || (pos // 40), 'r' || pos, pos % 20, CASE WHEN pos % 5 = 0 THEN 'own' END FROM e WHERE event_type = 'click' AND pos % 2 = 0
          UNION ALL SELECT session, pos, 'thread_token_usage', 'session', 'cumulative', NULL, NULL, 'th', pos % 30, CASE WHEN pos % 5 = 0 THEN 'own' END FROM e WHERE event_type = 'click' AND pos % 3 = 0
          UNION ALL SELECT session, pos, 'last_token_usage', 'call', 'absolute', NULL, NULL, NULL, pos % 7, NULL FROM e WHERE event_type = 'purchase')
        SELECT u.session, 'codex:' || u.session || ':line:' || pos || ':' || f AS observation_id, scope, counter, scope_id, response_id, u.turn_id, model, CASE WHEN model IS NULL THEN asked END AS requested_model, i AS input_tokens, CAST(2 AS BIGINT) AS output_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens, CAST(NULL AS DOUBLE) AS cost
        FROM u LEFT JOIN t ON u.session = t.session AND u.turn_id = t.turn_id""",
    "store_conversation": """SELECT DISTINCT 'c' || o_custkey AS session, o_orderkey * 5 % 1000 AS at, 'o' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS mid, 'p' || l_linenumber AS pid, CASE WHEN o_orderkey % 3 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 't' || l_linenumber END AS text
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 5 <> 0 AND (l_orderkey + l_linenumber) % 4 = 0 AND l_linenumber <> 3""",
    "store_events": """WITH o AS (SELECT 'c' || o_custkey AS session, o_orderkey AS k, o_orderkey * 5 % 1000 AS tm, 'o' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS mid, o_orderkey % 3 = 0 AS u, o_orderkey % 4 = 1 AND o_orderkey % 3 <> 0 AS f FROM orders),
        p AS (SELECT DISTINCT o.*, l_linenumber AS l, (k + l_linenumber) % 4 AS t FROM o JOIN lineitem ON k = l_orderkey WHERE k % 5 <> 0),
        b AS (SELECT o.* FROM o LEFT JOIN (SELECT DISTINCT mid FROM p) q ON o.mid = q.mid WHERE q.mid IS NULL AND NOT u),
        x AS (
          SELECT session, tm, mid, 'p' || l AS pid, 0 AS n, CASE WHEN t = 1 THEN 'thinking' WHEN u THEN 'user_message' ELSE 'assistant_message' END AS type, CASE WHEN t = 1 THEN 'hm' ELSE 't' || l END AS text, CASE WHEN u AND t = 0 THEN 'human' END AS origin, NULL AS call_id, NULL AS name, NULL AS result_status, CASE WHEN t = 0 AND f THEN k END AS e FROM p WHERE t = 1 OR (t = 0 AND l <> 3 AND l % 5 <> 0)
          UNION ALL SELECT session, tm, mid, 'p' || l, 0, 'tool_call', NULL, NULL, 'k' || l, 'bash', NULL, NULL FROM p WHERE t = 2
          UNION ALL SELECT session, tm, mid, 'p' || l, 1, 'tool_result', CASE WHEN l % 3 = 0 THEN 'bad' ELSE 'out' END, NULL, 'k' || l, NULL, CASE WHEN l % 3 = 0 THEN 'error' ELSE 'ok' END, NULL FROM p WHERE t = 2 AND l % 3 <> 2
          UNION ALL SELECT session, tm, mid, NULL, 0, CASE WHEN f THEN 'assistant_message' ELSE 'lifecycle' END, CASE WHEN f AND k % 2 <> 0 THEN '429: gone wrong' WHEN f THEN 'gone wrong' ELSE 'empty assistant message' END, NULL, NULL, NULL, NULL, CASE WHEN f THEN k END FROM b WHERE f OR k % 7 <> 0
          UNION ALL SELECT session, 4611686018427387904, lpad(CAST(any_value(tm) AS VARCHAR), 20, '0') || mid, '', 0, 'assistant_message', CASE WHEN any_value(k) % 2 <> 0 THEN '429: gone wrong' ELSE 'gone wrong' END, NULL, NULL, NULL, NULL, any_value(k) FROM p WHERE f GROUP BY session, mid HAVING count(*) FILTER (t = 0 AND l <> 3 AND l % 5 <> 0) = 0)
        SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY tm, mid, pid NULLS FIRST, n) AS BIGINT) AS seq, type, text, origin, call_id, right(mid, 10) AS message_id, name, result_status, CASE WHEN e % 2 <> 0 THEN '429' END AS error_code,
               CASE WHEN e % 2 = 0 THEN 'user_interrupt' WHEN e IS NOT NULL THEN 'rate_limited' END AS error_kind, CASE WHEN e % 2 = 0 THEN FALSE WHEN e IS NOT NULL THEN TRUE END AS retryable FROM x""",
    "conformance_report": """WITH l AS (SELECT user_id AS session, event_id AS seq, event_type AS t, CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 5 <> 0 THEN json_extract_string(props, '$.k') END AS id FROM events),
        s AS (SELECT session FROM l GROUP BY 1 HAVING min(seq) <> 1 OR max(seq) <> count(*) OR count(DISTINCT seq) <> count(*)),
        c AS (SELECT session, id, min(seq) AS first FROM l WHERE t = 'click' AND id IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT l.session FROM l LEFT JOIN c ON l.session = c.session AND l.id = c.id WHERE t = 'purchase' AND l.id IS NOT NULL AND (first IS NULL OR first > seq))
        SELECT 'seq' AS rule, count(*) AS n, count(DISTINCT session) AS n_sessions FROM s HAVING count(*) > 0 UNION ALL SELECT 'tool_pairing', count(*), count(DISTINCT session) FROM r HAVING count(*) > 0""",
}
