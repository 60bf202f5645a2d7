"""Queries over message blobs and step transcripts, made of ``events``: a hundred neighbouring events are a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.operators import fingerprint
from loglattice.sources import blobs, steps


def _events(spark: SparkSession, sf_dir: str, head: str) -> DataFrame:
    session = F.concat(F.lit(head), F.floor(F.col("event_id") / 100).cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(session.alias("session"), F.col("event_id").alias("pos"), "event_type")


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _id(head: str, at: Column | None = None) -> Column:
    return F.concat(F.lit(head), (F.col("pos") if at is None else at).cast("string"))


def blob_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are calls and purchases results, six neighbours of one id; views are typed, signups context."""
    call = _id("c", F.floor(F.col("pos") / 6))
    part = lambda kind, *columns: F.array(F.struct(F.lit(kind).alias("type"), call.alias("toolCallId"), *columns)).alias("content")
    role = lambda name, content: F.to_json(F.struct(F.lit(name).alias("role"), content))
    raw = (
        F.when(_is("click"), role("assistant", part("tool-call", F.lit("Bash").alias("toolName"))))
        .when(_is("purchase"), role("tool", part("tool-result", F.when(F.col("pos") % 3 == 0, "error: no").otherwise(_id("fine ")).alias("result"))))
        .when(_is("view"), role("user", F.concat(F.lit("<user_query>\n look "), F.col("pos"), F.lit(" </user_query>")).alias("content")))
        .when(_is("signup"), role("user", _id("<user_info>").alias("content"))).otherwise(F.lit("[1]"))
    )
    return _events(spark, sf_dir, "b").select("session", "pos", raw.alias("raw"))


def blob_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.events(blob_lines(spark, sf_dir)).select("session", "seq", "pos", "type", "text", "origin", "call_id", "result_status")


def step_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks call; in even sessions a purchase right after a click answers to its step, in odd ones steps have no numbers and results come in turn."""
    exact = F.floor(F.col("pos") / 100) % 2 == 0
    before = Window.partitionBy("session").orderBy("pos")
    rows = _events(spark, sf_dir, "s").withColumns({"last": F.lag("event_type").over(before), "last_pos": F.lag("pos").over(before)})
    follows = _is("purchase") & (F.col("last") == "click")
    step = F.when(follows, F.col("last_pos") + 1).otherwise(F.col("pos"))
    kind = F.when(_is("click"), "PLANNER_RESPONSE").when(_is("purchase"), F.when(~exact | follows, "RUN_COMMAND").otherwise("ODD")).when(_is("signup"), "USER_INPUT").when(_is("error"), "ERROR_MESSAGE").otherwise("CHECKPOINT")
    columns = [
        kind.alias("type"), F.lit("USER_EXPLICIT").alias("source"), F.when(F.col("pos") % 7 == 0, "RUNNING").otherwise("DONE").alias("status"),
        F.when(~_is("error"), F.when(_is("click") & (F.col("pos") % 2 == 0), "None").otherwise(_id(" at "))).alias("content"), F.when(_is("error"), "boom").alias("error"), F.when(_is("click"), F.array(F.struct(F.lit("run").alias("name")))).alias("tool_calls"),
    ]
    raw = F.when(exact, F.to_json(F.struct(step.alias("step_index"), *columns))).otherwise(F.to_json(F.struct(F.lit("?").alias("step_index"), *columns)))
    return rows.select("session", "pos", raw.alias("raw"))


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.events(step_lines(spark, sf_dir)).select("session", "seq", "type", "text", "origin", "call_id", "result_status", "error")


def store_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a store whose rows come in the order of their keys; the comment's place is taken by the price's digits."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("kind"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 17).cast("int")).alias("body"))
    return fingerprint.fingerprint(orders, ["store"], "pos", ["pos", "kind"], ["body"])


def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every store: some grew, some had a row edited, some are new or gone."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("kind"))
    old = fingerprint.fingerprint(orders.filter("store % 7 <> 0 and (store % 5 <> 0 or pos % 3 <> 0)"), ["store"], "pos", ["pos", "kind"])
    new = orders.filter("store % 11 <> 0").withColumn("kind", F.when((F.col("store") % 13 == 0) & (F.col("pos") % 4 == 0), "edited").otherwise(F.col("kind")))
    return fingerprint.changes(old, new, ["store"], "pos", ["pos", "kind"])


QUERIES = {f.__name__: f for f in (blob_events, step_events, store_fingerprints, store_changes)}

ORACLES = {
    "blob_events": """
WITH e AS (SELECT 'b' || CAST(floor(event_id / 100) AS BIGINT) AS session, event_id AS pos, event_type AS k, 'c' || CAST(floor(event_id / 6) AS BIGINT) AS id FROM events),
c AS (SELECT session, id, min(pos) AS call FROM e WHERE k = 'click' GROUP BY ALL),
r AS (SELECT e.session, e.id, pos, call FROM e LEFT JOIN c ON e.session = c.session AND e.id = c.id WHERE k = 'purchase'),
p AS (SELECT session, id, pos, pos AS spot, 0 AS place, 0 AS after FROM r WHERE pos > call
      UNION ALL SELECT session, id, max(pos), coalesce(max(call), 4611686018427387903), CASE WHEN max(call) IS NULL THEN min(pos) ELSE 0 END, CASE WHEN max(call) IS NULL THEN 0 ELSE 1 END FROM r WHERE call IS NULL OR pos < call GROUP BY session, id),
a AS (SELECT session, pos, pos AS spot, 0 AS place, 0 AS after, CASE k WHEN 'click' THEN 'tool_call' ELSE 'user_message' END AS type, CASE k WHEN 'view' THEN 'look ' || pos WHEN 'signup' THEN '<user_info>' || pos END AS text,
             CASE k WHEN 'view' THEN 'human' WHEN 'signup' THEN 'injected' END AS origin, CASE k WHEN 'click' THEN id END AS call_id, NULL AS result_status FROM e WHERE k IN ('click', 'view', 'signup')
      UNION ALL SELECT session, pos, spot, place, after, 'tool_result', CASE WHEN pos % 3 = 0 THEN 'error: no' ELSE 'fine ' || pos END, NULL, id, CASE WHEN pos % 3 = 0 THEN 'error' ELSE 'unknown' END FROM p)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY spot, place, after) AS seq, pos, type, text, origin, call_id, result_status FROM a
""",
    "step_events": """
WITH e AS (SELECT 's' || CAST(floor(event_id / 100) AS BIGINT) AS session, event_id AS pos, event_type AS k, CAST(floor(event_id / 100) AS BIGINT) % 2 = 0 AS exact FROM events),
l AS (SELECT *, lag(k) OVER w AS lk, lag(pos) OVER w AS lp, sum(CASE WHEN k = 'signup' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS part, row_number() OVER (PARTITION BY session, k ORDER BY pos) AS nth FROM e WINDOW w AS (PARTITION BY session ORDER BY pos)),
c AS (SELECT session, part, pos, CASE WHEN exact THEN pos || '-0' WHEN nth = 1 THEN '0-0' ELSE '0-0:' || pos END AS call_id FROM l WHERE k = 'click'),
q AS (SELECT session, part, pos, k, sum(CASE k WHEN 'click' THEN 1 ELSE -1 END) OVER w AS s FROM l WHERE NOT exact AND k IN ('click', 'purchase') WINDOW w AS (PARTITION BY session, part ORDER BY pos)),
m AS (SELECT *, k = 'purchase' AND s < least(0, coalesce(min(s) OVER (PARTITION BY session, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lost FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY session, part, k, lost ORDER BY pos) AS n FROM m),
f AS (SELECT b.session, b.pos, c.call_id FROM n a JOIN n b ON a.session = b.session AND a.part = b.part AND a.n = b.n AND a.k = 'click' AND b.k = 'purchase' AND NOT b.lost JOIN c ON c.session = a.session AND c.pos = a.pos
      UNION ALL SELECT session, pos, lp || '-0' FROM l WHERE exact AND k = 'purchase' AND lk = 'click'),
a AS (SELECT session, pos, 0 AS sub, CASE k WHEN 'signup' THEN 'user_message' WHEN 'view' THEN 'compaction' ELSE 'assistant_message' END AS type, CASE k WHEN 'error' THEN 'boom' ELSE 'at ' || pos END AS text,
             CASE k WHEN 'signup' THEN 'human' END AS origin, NULL AS call_id, NULL AS result_status, CASE k WHEN 'error' THEN 'boom' END AS error FROM l WHERE k IN ('signup', 'view', 'error') OR k = 'click' AND pos % 2 <> 0
      UNION ALL SELECT session, pos, 1, 'tool_call', NULL, NULL, call_id, NULL, NULL FROM c
      UNION ALL SELECT l.session, l.pos, 0, 'tool_result', 'at ' || l.pos, NULL, coalesce(f.call_id, ''), CASE WHEN l.pos % 7 = 0 THEN 'unknown' ELSE 'ok' END, NULL FROM l LEFT JOIN f ON l.session = f.session AND l.pos = f.pos WHERE k = 'purchase' AND (NOT exact OR lk = 'click'))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY pos, sub) AS seq, type, text, origin, call_id, result_status, error FROM a
""",
    "store_fingerprints": """
WITH r AS (SELECT o_custkey AS store, o_orderkey AS pos, md5('=' || o_orderkey || chr(31) || coalesce('=' || o_orderstatus, '-') || chr(31) || (o_orderkey % 17)) AS d FROM orders),
l AS (SELECT store, count(*) AS n, max(pos) AS last, list(('0x' || substr(d, 1, 7))::HUGEINT ORDER BY pos) AS a, list(('0x' || substr(d, 9, 7))::HUGEINT ORDER BY pos) AS b FROM r GROUP BY store)
SELECT store, list_reduce(list_prepend(0::HUGEINT, a), lambda x, y: (x * 1000003 + y) % 2147483647) || '-' || list_reduce(list_prepend(0::HUGEINT, b), lambda x, y: (x * 998244353 + y) % 2147483629) AS fingerprint, n, CAST(last AS BIGINT) AS last FROM l
""",
    "store_changes": """
WITH o AS (SELECT o_custkey AS s, o_orderkey AS p, o_orderstatus AS k, o_custkey % 7 <> 0 AND (o_custkey % 5 <> 0 OR o_orderkey % 3 <> 0) AS was, o_custkey % 11 <> 0 AS now, o_custkey % 13 = 0 AND o_orderkey % 4 = 0 AND o_orderstatus <> 'edited' AS ed FROM orders),
l AS (SELECT s, max(p) FILTER (was) AS last, count(*) FILTER (was) AS n0, count(*) FILTER (now) AS n1 FROM o GROUP BY s),
c AS (SELECT l.s, n0, n1, bool_or(p <= last AND now AND (ed OR NOT was)) AS ch FROM l JOIN o ON o.s = l.s GROUP BY ALL)
SELECT s AS store, CASE WHEN n1 = 0 THEN 'gone' WHEN n0 = 0 THEN 'new' WHEN coalesce(ch, false) THEN 'changed' WHEN n1 > n0 THEN 'appended' ELSE 'same' END AS verdict FROM c WHERE n0 + n1 > 0
""",
}
