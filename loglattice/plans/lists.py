"""Queries over session lists, their filters, pages and set operations.

Customers and suppliers are sessions of three sources; a nation is a folder and
a key within it a project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions import text as tx
from loglattice.operators import filters, turns
from loglattice.plans.dialogue import activity, dialogue

_TAGS = dict(zip(("done", "pending", "aborted"), filters.STATUS_LABELS, strict=True))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(key: str):
    return F.when(F.col(key) % 3 == 0, "a").when(F.col(key) % 3 == 1, "b").otherwise("c")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    tag = F.when(key % 5 == 0, _TAGS["done"]).when(key % 5 == 1, _TAGS["pending"]).when(key % 5 == 2, _TAGS["aborted"]).when(key % 5 == 3, "")
    folder = F.when(key % 13 != 0, F.concat(F.lit("/Home/n"), "c_nationkey", F.lit("/p"), (key % 40).cast("string")))
    return _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"), _source("c_custkey").alias("source"), tag.alias("status_tag"), folder.alias("cwd"), F.when(key % 11 != 0, (key * 37 % 1009).cast("double")).alias("mtime"),
        F.when(key % 4 != 3, key % 4 == 0).alias("live"), (key % 17 == 0).alias("internal"), F.when(key % 6 != 0, F.when(key % 7 == 0, "  ").otherwise("hello")).alias("user_text"),
    )


def list_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown status, a folder with ``HOME/n1`` in any case, live, between two times; four fields."""
    rows = filters.select_sessions(sessions(spark, sf_dir), status="unknown", cwd="HOME/n1", cwd_prefix="/Home", live=True, since=100, until=900)
    return filters.pick_fields(rows, ["mtime", "id", "source", "cwd", "missing"])


def list_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each session is dropped; nations are known folders, every fifth of them marked, and so are most projects."""
    nations = _table(spark, sf_dir, "nation").select(F.concat(F.lit("/Home/n"), "n_nationkey").alias("path"), (F.col("n_nationkey") % 5 == 0).alias("marked"))
    projects = nations.select("path", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("n")).select(F.concat("path", F.lit("/p"), F.col("n").cast("string")).alias("path"), F.lit(False).alias("marked"))
    told = filters.with_folders(sessions(spark, sf_dir), nations.union(projects))
    return told.select("id", "source", "known", "marked", filters.exclusion(F.col("known"), F.col("marked"), F.col("cwd"), F.col("internal"), F.col("user_text")).alias("excluded"))


def list_of_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, and of the suppliers those whose key no customer of the first half has; suppliers have no folder."""
    old = sessions(spark, sf_dir).filter(F.substring("id", 2, 20).cast("long") % 2 == 0).select("id", "source", "cwd")
    new = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("d").alias("source"))
    return filters.union_sources(filters.prefer_first(old, new, "id"), old.filter("source = 'a'").select("id", "source"))


def references_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact id that others begin with, an ambiguous beginning, one within a source, and one that is missing."""
    held = sessions(spark, sf_dir)
    asked = [filters.resolve_reference(held, ref).select(F.lit(ref).alias("ref"), "verdict", "n", F.array_join("candidates", ",").alias("candidates")) for ref in ("s1", "s2", "s", "b:s1", "x9")]
    return filters.union_sources(*asked)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    scope = F.when(line % 4 == 0, "message").when(line % 4 == 1, "call").when(line % 4 == 2, "turn").otherwise("session")
    name = lambda head, key: F.concat(F.lit(head), F.col(key).cast("string"))
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("session"), (F.col("l_orderkey") * 10 + line).alias("pos"), scope.alias("scope"), name("t", "l_orderkey").alias("turn_id"), F.when(line % 3 != 0, name("m", "l_partkey")).alias("message_id"), F.when(line % 2 == 0, name("m", "l_partkey")).alias("response_id"),
        F.when(line % 3 != 1, name("x", "l_linenumber")).alias("model"), F.when(line % 3 == 1, "x2").alias("requested_model"),
    )


def usage_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three messages and two models, and of two turns."""
    rows = _records(spark, sf_dir)
    by_message = filters.select_usage(rows, messages=["m1", "m2", "m3", "m50"], models=["x2", "x5"]).withColumn("asked", F.lit("messages"))
    by_turn = filters.select_usage(rows, turns=["t1", "t2"], messages=["m1"]).withColumn("asked", F.lit("turns"))
    return by_message.union(by_turn)


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of messages: a part of even number is a plain message, an odd one a namespaced one in two entries of ten."""
    lines = _table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey").cast("string")
    name = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("m"), key)).otherwise(F.concat(F.lit("z"), F.when(F.col("l_partkey") % 10 == 1, F.col("l_linenumber").cast("string")).otherwise(""), F.lit(":message:m"), key))
    return lines.select(F.col("l_suppkey").alias("session"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), name.alias("message_id"))


def models_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.message_models(_records(spark, sf_dir), _sent(spark, sf_dir)).select("session", "pos", "message_id", "response_id", "attribution", "seq")


def sequence_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).filter("message_id IS NOT NULL").withColumn("seq", F.when(F.col("pos") % 3 == 0, F.lit(-1)).cast("long"))
    return filters.backfill_by_suffix(rows, _sent(spark, sf_dir)).select("session", "pos", "message_id", "seq")


def stamped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = turns.with_turn_index(activity(spark, sf_dir))
    return filters.with_turn_ids(events, turns.turns(activity(spark, sf_dir))).select("session", "seq", "turn_id")


def sequence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations count from 0, so each is at fault; counted from 1, those that lost a row are."""
    rows = dialogue(spark, sf_dir).select("session", (F.col("seq") + F.when(F.col("session") % 3 == 0, 1).otherwise(0)).alias("seq"), "type").filter("NOT (session % 6 = 0 AND seq = 2)")
    return filters.sequence_faults(rows)


def weighted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff("l_shipdate", F.lit("1995-01-01"))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_quantity").cast("long").alias("tokens"), days.cast("long").alias("duration_ms"))
    return filters.weighted_rate(rows, ["model"])


def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), F.concat(F.lit("line:"), "event_id").alias("record"))
    return filters.performance_summary(rows, 4).withColumn("kinds", F.array_join("kinds", ","))


def first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("start"))
    return filters.first_requests(rows.withColumn("end", F.col("start") + F.col("pos") % 30))


def version_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text", (F.col("conv_id") * 10 + F.col("turn")).alias("updated"))
    return filters.version_marks(rows)


def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("event_type") == "click", "native").when(F.col("event_type") == "view", "inferred").when(F.col("event_type") == "error", "unknown")
    return filters.evidence_counts(_table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), told.alias("evidence")))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each of four rules; orders without lines, lines with an odd discount, shipments before their order, nations without a region."""
    orders, lines, nations = (_table(spark, sf_dir, t) for t in ("orders", "lineitem", "nation"))
    return filters.violations_by_rule({
        "call_without_result": orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
        "odd_value": lines.filter("l_discount > 0.07 AND l_tax < 0.02"),
        "result_before_call": lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).filter("l_shipdate < o_orderdate"),
        "no_parent": nations.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti"),
    })


def pages_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three messages before the fifth of every conversation, and the last two of each."""
    rows = dialogue(spark, sf_dir).select("session", "seq")
    return filters.page_before(rows, 4, 3).withColumn("asked", F.lit("before")).union(filters.page_before(rows, None, 2).withColumn("asked", F.lit("last")))


def page_by_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a list in the order of time, oldest first (a report of 40 rows)."""
    held = sessions(spark, sf_dir).filter("mtime IS NOT NULL").select("id", "mtime")
    _, token = filters.page_after(held, ["mtime", "id"], "g1", size=40, bound="export")
    return filters.page_after(held, ["mtime", "id"], "g1", token, 40, "export")[0]


def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, addresses, times and ids of sessions."""
    rows = sessions(spark, sf_dir)
    address = F.concat(F.lit("file:///a%20b+c/"), "id")
    stamp = F.when(F.col("mtime") % 2 == 0, F.concat(F.lit("2024-02-0"), (F.col("mtime") % 9 + 1).cast("int"), F.lit("T10:20:30.5Z"))).otherwise(F.col("id"))
    return rows.select(
        "id", tx.short_folder(F.col("cwd"), "/Home/n1").alias("folder"), tx.file_path(address).alias("path"), tx.file_path(F.col("id")).alias("same"), tx.message_time(F.col("mtime") * 86_400).alias("shown"),
        tx.iso_seconds(stamp).alias("stamp"), tx.performance_id(F.col("id"), F.col("source"), F.lit("line:1"), F.lit("turn")).alias("performance_id"), filters.bare_id(F.concat(F.lit("x:entry:"), "id")).alias("bare"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        list_selected, list_exclusions, list_of_all_sources, references_resolved, usage_selected, models_of_messages, sequence_backfill, stamped_turns, sequence_faults, weighted_rates,
        performance_summary, first_requests, version_marks, evidence_counts, violations, pages_backward, page_by_cursor, small_texts,
    )
}

_S = """s AS (SELECT 's' || c_custkey AS id, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, CASE WHEN c_custkey % 13 <> 0 THEN '/Home/n' || c_nationkey || '/p' || (c_custkey % 40) END AS cwd,
    c_nationkey AS nation, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 37 % 1009)::DOUBLE END AS mtime FROM customer)"""
_R = """r AS (SELECT l_suppkey AS session, l_orderkey * 10 + l_linenumber AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'call' WHEN 2 THEN 'turn' ELSE 'session' END AS scope, 't' || l_orderkey AS turn_id,
    CASE WHEN l_linenumber % 3 <> 0 THEN 'm' || l_partkey END AS message_id, CASE WHEN l_linenumber % 2 = 0 THEN 'm' || l_partkey END AS response_id, CASE WHEN l_linenumber % 3 <> 1 THEN 'x' || l_linenumber END AS model, CASE WHEN l_linenumber % 3 = 1 THEN 'x2' END AS requested_model FROM lineitem),
  f AS (SELECT session, message_id, min(seq) AS seq FROM (SELECT l_suppkey AS session, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 2 = 0 THEN 'm' || l_partkey ELSE 'z' || CASE WHEN l_partkey % 10 = 1 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END || ':message:m' || l_partkey END AS message_id FROM lineitem) GROUP BY 1, 2)"""

ORACLES = {
    "list_selected": f"WITH {_S} SELECT id, source, cwd, mtime FROM s WHERE k % 5 IN (3, 4) AND contains(lower(cwd), 'home/n1') AND k % 4 = 0 AND mtime BETWEEN 100 AND 900",
    "list_exclusions": f"""WITH {_S}, w AS (SELECT *, coalesce(cwd IS NOT NULL AND k % 40 < 30, FALSE) AS known, coalesce(cwd IS NOT NULL AND nation % 5 = 0, FALSE) AS marked FROM s)
        SELECT id, source, known, marked, CASE WHEN k % 17 = 0 THEN 'internal' WHEN cwd IS NULL OR NOT known THEN 'missing_cwd' WHEN marked THEN 'ephemeral_marker' WHEN k % 6 = 0 OR k % 7 = 0 THEN 'empty_user' END AS excluded FROM w""",
    "list_of_all_sources": f"""WITH {_S}, o AS (SELECT id, source, cwd FROM s WHERE k % 2 = 0)
        SELECT * FROM o UNION ALL SELECT 's' || s_suppkey, 'd', NULL FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT id FROM o) UNION ALL SELECT id, source, NULL FROM o WHERE source = 'a'""",
    "references_resolved": f"""WITH {_S}, q(ref, src, ident) AS (VALUES ('s1', '', 's1'), ('s2', '', 's2'), ('s', '', 's'), ('b:s1', 'b', 's1'), ('x9', '', 'x9')),
        h AS (SELECT ref, source || ':' || id AS key, id = ident AS exact FROM q JOIN s ON (starts_with(id, ident) OR left(id, 8) = ident) AND (src = '' OR source = src)),
        g AS (SELECT ref, count(*) AS n, count(*) FILTER (exact) AS e, min(key) FILTER (exact) AS best, list(key ORDER BY key)[1:10] AS keys FROM h GROUP BY ref)
        SELECT q.ref, CASE WHEN n IS NULL THEN 'not_found' WHEN e = 1 OR n = 1 THEN 'found' ELSE 'ambiguous' END AS verdict, coalesce(n, 0) AS n, CASE WHEN e = 1 THEN best ELSE coalesce(array_to_string(keys, ','), '') END AS candidates FROM q LEFT JOIN g ON q.ref = g.ref""",
    "usage_selected": f"""WITH {_R} SELECT *, 'messages' AS asked FROM r WHERE (message_id IN ('m1', 'm2', 'm3', 'm50') OR coalesce(response_id IN ('m1', 'm2', 'm3', 'm50'), FALSE)) AND (coalesce(model IN ('x2', 'x5'), FALSE) OR coalesce(requested_model IN ('x2', 'x5'), FALSE))
        UNION ALL SELECT *, 'turns' FROM r WHERE turn_id IN ('t1', 't2')""",
    "models_of_messages": f"""WITH {_R} SELECT r.session, pos, r.message_id, r.response_id, CASE WHEN scope = 'message' THEN 'message' WHEN scope IN ('call', 'turn') THEN 'turn' ELSE 'unknown' END AS attribution, coalesce(a.seq, b.seq) AS seq
        FROM r LEFT JOIN f a ON r.session = a.session AND r.message_id = a.message_id LEFT JOIN f b ON r.session = b.session AND r.response_id = b.message_id""",
    "sequence_backfill": f"""WITH {_R}, b AS (SELECT session, regexp_replace(message_id, '^.*:message:', '') AS bare, min(seq) AS seq FROM f GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT r.session, pos, r.message_id, coalesce(CASE WHEN pos % 3 = 0 THEN -1 END, a.seq, b.seq) AS seq FROM r LEFT JOIN f a ON r.session = a.session AND r.message_id = a.message_id LEFT JOIN b ON r.session = b.session AND r.message_id = b.bare WHERE r.message_id IS NOT NULL""",
    "stamped_turns": """WITH e AS (SELECT user_id AS session, event_id AS seq, event_type = 'signup' AS u FROM events), i AS (SELECT *, sum(u::INT) OVER w - first_value(u::INT) OVER w AS t FROM e WINDOW w AS (PARTITION BY session ORDER BY seq))
        SELECT session, seq, printf('turn-%04d', CAST(t AS BIGINT)) AS turn_id FROM i""",
    "sequence_faults": """WITH r AS (SELECT conv_id AS session, turn + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS seq FROM conversations), k AS (SELECT * FROM r WHERE NOT (session % 6 = 0 AND seq = 2))
        SELECT session, count(*) AS expected, count(DISTINCT seq) AS found FROM k GROUP BY 1 HAVING min(seq) <> 1 OR max(seq) <> count(*) OR count(DISTINCT seq) <> count(*)""",
    "weighted_rates": """SELECT l_suppkey AS model, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(datediff('day', DATE '1995-01-01', l_shipdate::DATE)) AS BIGINT) AS duration_ms, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) * 1000 / sum(datediff('day', DATE '1995-01-01', l_shipdate::DATE))::DOUBLE AS tokens_per_second
        FROM lineitem WHERE datediff('day', DATE '1995-01-01', l_shipdate::DATE) > 0 GROUP BY 1""",
    "performance_summary": """WITH k AS (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY 1, 2), l AS (SELECT user_id, array_to_string(list(event_type ORDER BY p)[1:4], ',') AS kinds FROM k GROUP BY 1)
        SELECT e.user_id AS session, count(*) AS n, 'line:' || max(event_id) AS latest, any_value(kinds) AS kinds FROM events e JOIN l ON e.user_id = l.user_id GROUP BY 1""",
    "first_requests": """WITH r AS (SELECT l_suppkey AS session, l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos, CAST(datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS INT) AS start FROM lineitem)
        SELECT session, id, arg_min(start, pos) AS start, max(start + pos % 30) AS "end" FROM r GROUP BY 1, 2""",
    "version_marks": "SELECT conv_id AS session, count(*) AS n, max(conv_id * 10 + turn) AS latest, CAST(sum(conv_id * 10 + turn) AS BIGINT) AS sum_updated, CAST(sum(turn) AS BIGINT) AS sum_seq, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM conversations GROUP BY 1",
    "evidence_counts": "SELECT user_id AS session, count(*) FILTER (event_type = 'click') AS n_native, count(*) FILTER (event_type = 'view') AS n_inferred, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_unknown FROM events GROUP BY 1",
    "violations": """SELECT 'call_without_result' AS rule, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'odd_value', count(*) FROM lineitem WHERE l_discount > 0.07::DOUBLE AND l_tax < 0.02::DOUBLE
        UNION ALL SELECT 'result_before_call', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'no_parent', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)""",
    "pages_backward": """WITH p AS (SELECT conv_id AS session, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
        SELECT session, seq, CAST(place AS INT) AS place, 'before' AS asked FROM p WHERE place < least(n, 4) AND place >= least(n, 4) - 3 UNION ALL SELECT session, seq, CAST(place AS INT), 'last' FROM p WHERE place >= n - 2""",
    "page_by_cursor": f"WITH {_S} SELECT id, mtime FROM s WHERE mtime IS NOT NULL ORDER BY mtime, id LIMIT 40 OFFSET 40",
    "small_texts": f"""WITH {_S} SELECT id, CASE WHEN starts_with(cwd, '/Home/n1') THEN '~' || substr(cwd, 9) ELSE cwd END AS folder, '/a b+c/' || id AS path, id AS same, strftime(make_timestamp(CAST(mtime * 86400000000 AS BIGINT)), '%m-%d %H:%M') AS shown,
        CASE WHEN mtime % 2 = 0 THEN epoch_us(TIMESTAMP '2024-02-01 10:20:30.5') / 1e6::DOUBLE + (mtime % 9) * 86400 END AS stamp, id || '|' || source || ':line:1:turn' AS performance_id, id AS bare FROM s""",
}
