"""Queries over conversations and tool calls.

``conversations`` rows are events: system rows count as injected user rows.
``events`` rows are a richer log: clicks are calls, purchases results, views
and errors agent messages, signups user messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions import text as tx
from loglattice.operators import listing, matching, turns

WORDS = ["the", "ation"]


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.when(F.col("role") == "assistant", "assistant_message").otherwise("user_message")
    none = [F.lit(None).cast("string").alias(c) for c in ("call_id", "turn_id", "error_kind", "stop_reason")]
    return rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), kind.alias("type"), "text", F.when(F.col("role") == "system", "injected").alias("origin"), *none)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = {"click": "tool_call", "purchase": "tool_result", "signup": "user_message"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("event_type")), F.lit("assistant_message"))
    key = F.get_json_object("props", "$.k")
    none = [F.lit(None).cast("string").alias(c) for c in ("origin", "turn_id", "stop_reason")]
    call = F.when(F.col("event_type").isin("click", "purchase") & (key.cast("int") % 5 != 0), key)
    return rows.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("props").alias("text"), call.alias("call_id"), F.when(F.col("event_type") == "error", "provider_error").alias("error_kind"), *none)


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turns(dialogue(spark, sf_dir)).select("session", "turn_index", "turn_id", "start_seq", "end_seq", "event_count", "status")


def activity_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turns(activity(spark, sf_dir)).select("session", "turn_index", "turn_id", "start_seq", "end_seq", "event_count", "status", "error_kind")


def session_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.session_outcomes(turns.turns(activity(spark, sf_dir)))


def conversation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.conversation(dialogue(spark, sf_dir))


def compact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.compact_view(dialogue(spark, sf_dir)).select("session", "seq", "view_seq", "type")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.event_counts(activity(spark, sf_dir))


def loop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.loop_counts(activity(spark, sf_dir))


def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.tail(turns.conversation(dialogue(spark, sf_dir)), 3).select("session", "seq", "role", tx.excerpt(F.col("text")).alias("excerpt"))


def completion_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of each conversation's last agent message, as a finished round anchored at its place."""
    rows = dialogue(spark, sf_dir).filter("type = 'assistant_message'")
    last = rows.groupBy("session").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"))
    return last.select("session", tx.completion_id(F.lit("done"), F.concat_ws(":", "session", "seq"), F.col("text")).alias("completion_id"))


def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_facts(dialogue(spark, sf_dir)).select("session", "n_user", "n_agent", "n_bytes", F.substring("first_user_msg", 1, 300).alias("first_user_excerpt"), F.substring("last_agent_msg", 1, 300).alias("last_agent_excerpt"))


def search_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = listing.list_facts(dialogue(spark, sf_dir)).withColumn("title", F.substring("first_user_msg", 1, 60))
    return listing.search_quick(facts, WORDS).select("session", "score")


def search_deep_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.search_deep(dialogue(spark, sf_dir), WORDS)


def session_recency_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 users seen last, of each event type's 50 (a report)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    sessions = rows.groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("id")).agg(F.max("event_id").alias("mtime"))
    return listing.recent(sessions, top=20, depth=50)


def pair_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls and their first lines as results, paired by key."""
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    calls = orders.select(F.lit(0).alias("session"), F.col("o_orderkey").alias("call_id"), F.col("o_orderkey").alias("call_seq"))
    state = F.create_map(*[F.lit(x) for p in {"N": "ok", "A": "error", "R": "denied"}.items() for x in p])
    results = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("n"), F.min("l_returnflag").alias("f"))
    results = results.select(F.lit(0).alias("session"), F.col("l_orderkey").alias("call_id"), F.col("n").cast("long").alias("result_seq"), F.try_element_at(state, F.col("f")).alias("result_status"), F.when(F.col("l_orderkey") % 2 == 0, "it timed out").alias("output"))
    return turns.pair_by_id(calls, results).drop("session")


def pair_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated, missing and unknown ids."""
    return matching.in_order(activity(spark, sf_dir))


def queued_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that take the earliest open call of their session, whatever their id."""
    rows = activity(spark, sf_dir).filter(F.col("type").isin("tool_call", "tool_result"))
    return matching.queue_pairs(rows.select("session", "seq", (F.col("type") == "tool_call").alias("opens")), ["session"])


QUERIES = {
    f.__name__: f
    for f in (conversation_turns, activity_turns, session_outcome, conversation_projection, compact_view, event_counts, loop_count, last_n_messages, completion_ids, session_facts, search_quick, search_deep_snippet, session_recency_top, pair_invocations, pair_in_order, queued_results)
}

_DIALOGUE = "e AS (SELECT conv_id AS session, turn AS seq, CASE WHEN role = 'assistant' THEN 'assistant_message' ELSE 'user_message' END AS type, text, CASE WHEN role = 'system' THEN 'injected' END AS origin, NULL::VARCHAR AS call_id, NULL::VARCHAR AS error_kind FROM conversations)"
_ACTIVITY = """e AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'tool_result' WHEN 'signup' THEN 'user_message' ELSE 'assistant_message' END AS type,
 CASE WHEN event_type IN ('click', 'purchase') AND CAST(json_extract_string(props, '$.k') AS INT) % 5 <> 0 THEN json_extract_string(props, '$.k') END AS call_id, CASE WHEN event_type = 'error' THEN 'provider_error' END AS error_kind FROM events)"""
_TURNS = """
u AS (SELECT *, sum(CASE WHEN type = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)
      - CASE WHEN first_value(type) OVER (PARTITION BY session ORDER BY seq) = 'user_message' THEN 1 ELSE 0 END AS turn_index FROM e),
q AS (SELECT session, turn_index, count(*) AS n_open FROM (SELECT session, turn_index, call_id FROM u WHERE call_id IS NOT NULL GROUP BY ALL HAVING NOT bool_or(type = 'tool_result')) GROUP BY ALL),
s AS (SELECT session, turn_index, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS event_count,
      coalesce(max(CASE WHEN error_kind IS NOT NULL THEN seq END), -1) AS es, coalesce(max(CASE WHEN error_kind IS NULL AND type <> 'user_message' THEN seq END), -1) AS cs,
      arg_max(type, seq) AS lt, bool_or(type <> 'user_message') AS agent,
      count(*) FILTER (type = 'tool_call' AND call_id IS NULL) > count(*) FILTER (type = 'tool_result' AND call_id IS NULL) AS unkeyed,
      turn_index = max(turn_index) OVER (PARTITION BY session) AS is_last FROM u GROUP BY session, turn_index),
t AS (SELECT s.session, CAST(s.turn_index AS BIGINT) AS turn_index, printf('turn-%04d', CAST(s.turn_index AS BIGINT)) AS turn_id, start_seq, end_seq, event_count,
      CASE WHEN es > cs THEN 'failed' WHEN is_last AND lt = 'user_message' THEN 'in_progress' WHEN agent AND is_last AND (unkeyed OR n_open > 0) THEN 'unknown'
           WHEN agent THEN 'completed' WHEN NOT is_last THEN 'unknown' ELSE 'in_progress' END AS status, CASE WHEN es > cs THEN 'provider_error' END AS error_kind
      FROM s LEFT JOIN q ON s.session = q.session AND s.turn_index = q.turn_index)"""
_SHOWN = "type IN ('user_message', 'assistant_message') AND regexp_matches(text, '\\S') AND origin IS NULL"
_FACTS = """f AS (SELECT session, arg_min(text, seq) FILTER (type = 'user_message') AS fu, arg_max(text, seq) FILTER (type = 'user_message') AS lu, arg_max(text, seq) FILTER (type = 'assistant_message') AS la,
 count(*) FILTER (type = 'user_message') AS n_user, count(*) FILTER (type = 'assistant_message') AS n_agent, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM e GROUP BY session)"""
_HIT = "instr(lower(text), '{0}')"


def _snip(word: str) -> str:
    at = _HIT.format(word)
    return f"CASE WHEN {at} > 0 THEN trim(substring(text, CAST(greatest(1, {at} - 40) AS INT), CAST({at} - greatest(1, {at} - 40) + {len(word)} + 80 AS INT))) END"


_SCORE = " + ".join(f"CASE WHEN contains(lower(coalesce({col}, '')), '{w}') THEN {weight} ELSE 0 END" for col, weight in (("substring(fu, 1, 60)", 100), ("fu", 60), ("lu", 60), ("la", 35)) for w in WORDS)

ORACLES = {
    "conversation_turns": f"WITH {_DIALOGUE}, {_TURNS} SELECT session, turn_index, turn_id, start_seq, end_seq, event_count, status FROM t",
    "activity_turns": f"WITH {_ACTIVITY}, {_TURNS} SELECT session, turn_index, turn_id, start_seq, end_seq, event_count, status, error_kind FROM t",
    "session_outcome": f"""WITH {_ACTIVITY}, {_TURNS} SELECT session, count(*) AS n_turns,
        CASE arg_max(status, turn_index) WHEN 'completed' THEN 'done' WHEN 'in_progress' THEN 'pending' WHEN 'failed' THEN 'aborted' ELSE 'unknown' END AS status FROM t GROUP BY session""",
    "conversation_projection": f"WITH {_DIALOGUE} SELECT session, seq, CASE WHEN type = 'user_message' THEN 'user' ELSE 'assistant' END AS role, text FROM e WHERE {_SHOWN}",
    "compact_view": f"WITH {_DIALOGUE} SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS view_seq, type FROM e WHERE origin IS NULL",
    "event_counts": f"WITH {_ACTIVITY} SELECT session, {', '.join(f'count(*) FILTER (type = {t!r}) AS n_{t}' for t in ('user_message', 'assistant_message', 'thinking', 'tool_call', 'tool_result'))} FROM e GROUP BY session",
    "loop_count": f"""WITH {_ACTIVITY}, m AS (SELECT session, type, lag(type) OVER (PARTITION BY session ORDER BY seq) AS p FROM e WHERE type IN ('user_message', 'assistant_message'))
        SELECT session, count(*) FILTER (type = 'assistant_message' AND p IS DISTINCT FROM 'assistant_message') AS loops FROM m GROUP BY session""",
    "last_n_messages": f"""WITH {_DIALOGUE} SELECT session, seq, CASE WHEN type = 'user_message' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN length(text) > 120 THEN substring(text, 1, 119) || '…' ELSE text END AS excerpt
        FROM e WHERE {_SHOWN} QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 3""",
    "completion_ids": f"""WITH {_DIALOGUE}, l AS (SELECT session, max(seq) AS seq, arg_max(text, seq) AS text FROM e WHERE type = 'assistant_message' GROUP BY session)
        SELECT session, 'done:' || substring(sha256(session || ':' || seq || chr(10) || substring(coalesce(text, ''), 1, 500)), 1, 16) AS completion_id FROM l""",
    "session_facts": f"WITH {_DIALOGUE}, {_FACTS} SELECT session, n_user, n_agent, n_bytes, substring(fu, 1, 300) AS first_user_excerpt, substring(la, 1, 300) AS last_agent_excerpt FROM f",
    "search_quick": f"""WITH {_DIALOGUE}, {_FACTS} SELECT session, {_SCORE} AS score FROM f
        WHERE {' AND '.join(f"contains(lower(concat_ws(chr(10), substring(fu, 1, 60), fu, lu, la)), '{w}')" for w in WORDS)}""",
    "search_deep_snippet": f"""WITH {_DIALOGUE}, h AS (SELECT session, seq, coalesce({', '.join(_snip(w) for w in WORDS)}) AS snippet, {', '.join(f"{_HIT.format(w)} > 0 AS h{k}" for k, w in enumerate(WORDS))} FROM e)
        SELECT session, min(seq) AS hit_seq, arg_min(snippet, seq) AS snippet FROM h WHERE {' OR '.join(f'h{k}' for k in range(len(WORDS)))} GROUP BY session HAVING {' AND '.join(f'bool_or(h{k})' for k in range(len(WORDS)))}""",
    "session_recency_top": """WITH s AS (SELECT event_type AS source, user_id AS id, max(event_id) AS mtime FROM events GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY max(event_id) DESC, user_id) <= 50)
        SELECT source, id, mtime FROM s ORDER BY mtime DESC, source, id LIMIT 20""",
    "pair_invocations": """WITH r AS (SELECT l_orderkey AS k, CAST(min(l_linenumber) AS BIGINT) AS n, min(l_returnflag) AS f FROM lineitem GROUP BY 1)
        SELECT coalesce(o_orderkey, k) AS call_id, o_orderkey AS call_seq, n AS result_seq, CASE f WHEN 'N' THEN 'ok' WHEN 'A' THEN 'error' WHEN 'R' THEN 'denied' END AS result_status,
        CASE WHEN o_orderkey IS NULL THEN 'orphan' WHEN f IS NULL THEN 'proposed' WHEN f = 'R' THEN 'denied' WHEN f = 'N' THEN 'succeeded' WHEN k % 2 = 0 THEN 'timed_out' ELSE 'failed' END AS status
        FROM orders FULL JOIN r ON o_orderkey = k""",
    "pair_in_order": f"""WITH {_ACTIVITY}, c AS (SELECT CAST(session AS VARCHAR) AS session, seq, nullif(call_id, '') AS call_id, type = 'tool_call' AS opens FROM e WHERE type IN ('tool_call', 'tool_result')),
        k AS (SELECT *, opens IS NOT DISTINCT FROM lag(opens) OVER (PARTITION BY session, call_id ORDER BY seq) AS again FROM c WHERE call_id IS NOT NULL),
        h AS (SELECT *, row_number() OVER (PARTITION BY session, call_id ORDER BY seq) AS n FROM k WHERE NOT again),
        p AS (SELECT a.session, a.call_id, a.seq AS call_seq, b.seq AS result_seq FROM h a LEFT JOIN h b ON a.session = b.session AND a.call_id = b.call_id AND b.n = a.n + 1 WHERE a.opens),
        x AS (SELECT session, seq, call_id, opens FROM c WHERE call_id IS NULL UNION ALL SELECT session, seq, call_id, opens FROM k WHERE again AND NOT opens UNION ALL SELECT session, seq, call_id, opens FROM h WHERE NOT opens AND n = 1),
        s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY session ORDER BY seq) + CASE WHEN opens THEN 0 ELSE 1 END AS lv FROM x),
        g AS (SELECT *, row_number() OVER (PARTITION BY session, lv, opens ORDER BY seq) - CASE WHEN NOT opens AND lv <= 0 THEN 1 ELSE 0 END AS n FROM s)
        SELECT session, call_id, call_seq, result_seq FROM p UNION ALL SELECT session, call_id, seq, NULL FROM k WHERE again AND opens
        UNION ALL SELECT coalesce(a.session, b.session), b.call_id, a.seq, b.seq FROM (SELECT * FROM g WHERE opens) a FULL JOIN (SELECT * FROM g WHERE NOT opens) b ON a.session = b.session AND a.lv = b.lv AND a.n = b.n""",
    "queued_results": f"""WITH {_ACTIVITY}, c AS (SELECT session, seq, type = 'tool_call' AS opens, sum(CASE type WHEN 'tool_call' THEN 1 ELSE -1 END) OVER (PARTITION BY session ORDER BY seq) AS s FROM e WHERE type IN ('tool_call', 'tool_result')),
        m AS (SELECT *, NOT opens AND s < least(0, coalesce(min(s) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lost FROM c),
        n AS (SELECT *, row_number() OVER (PARTITION BY session, opens, lost ORDER BY seq) AS n FROM m)
        SELECT coalesce(a.session, b.session) AS session, a.seq AS call_seq, b.seq AS result_seq FROM (SELECT * FROM n WHERE opens) a FULL JOIN (SELECT * FROM n WHERE NOT opens AND NOT lost) b ON a.session = b.session AND a.n = b.n
        UNION ALL SELECT session, NULL, seq FROM n WHERE lost""",
}
