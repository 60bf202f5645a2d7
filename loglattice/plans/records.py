"""Queries over usage, timing, errors and relations.

Lines of an order are the detailed observations of a turn, the order's total is
the turn's own counter, and all amounts are whole cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions import guards
from loglattice.functions import text as tx
from loglattice.operators import relations, usage
from loglattice.operators.intervals import micros


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    details = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("session"), F.col("l_orderkey").alias("turn_id"), _cents("l_extendedprice").alias("amount"))
    intervals = orders.filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("turn_id"), _cents("o_totalprice").alias("amount"))
    return usage.turn_residuals(details, intervals)


def usage_turn_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir)


def usage_residual_vs_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known totals and coverage of every customer; the rollup is the sum of the customer's order totals."""
    rollups = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.sum(_cents("o_totalprice")).alias("amount"))
    return usage.session_totals(_turns(spark, sf_dir), rollups)


def record_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as observations: by response (part), by turn counter or by themselves."""
    lines = _table(spark, sf_dir, "lineitem")
    scope = F.when(F.col("l_linestatus") == "O", "turn").otherwise("call")
    obs = lines.select(
        F.col("l_suppkey").alias("session"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("response_id"),
        F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("turn_id"), scope.alias("scope"), F.col("l_linenumber").alias("model"), F.col("l_quantity").cast("long").alias("input_tokens"), F.when(F.col("l_tax") > 0.02, _cents("l_discount")).alias("output_tokens"),
    )
    return usage.reconcile(obs, ["input_tokens", "output_tokens"]).drop("turn_id", "scope")


def normalise_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present parts of lines summed: discount and tax count as cache parts where they are not zero."""
    some = lambda c: F.when(F.col(c) > 0, _cents(c))
    obs = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("long")).alias("input_tokens"), some("l_discount").alias("cache_read_tokens"), some("l_tax").alias("cache_write_tokens"), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber").cast("long")).alias("output_tokens"))
    return usage.normalise(obs).select("l_orderkey", "l_linenumber", "input_total", "total_tokens")


def cost_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("currency"), F.col("l_linestatus").alias("basis"), F.when(F.col("l_tax") > 0, _cents("l_extendedprice")).alias("cost"))
    return usage.cost_groups(rows)


def by_model_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("model"), _cents("l_extendedprice").alias("amount"))
    return usage.model_slices(rows)


def nearest_index_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.nearest_percentile(_table(spark, sf_dir, "events"), ["event_type"], "value")


def perf_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined with the last shipment of their lines: milliseconds and quantity a second; clock reversals give no duration."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    replies = lines.groupBy("l_orderkey").agg(F.max(micros("l_shipdate")).alias("end_us"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"))
    both = replies.join(orders.select("o_orderkey", micros("o_orderdate").alias("start_us")), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    ms = guards.duration_ms((F.col("end_us") - F.col("start_us")) / 1000.0)
    why = F.when(F.col("start_us").isNull(), "missing_request").when(F.col("end_us") < F.col("start_us"), "clock_reversal").when(ms.isNull(), "empty")
    return both.select("l_orderkey", "tokens", ms.alias("duration_ms"), guards.token_rate(F.col("tokens"), ms).alias("tokens_per_second"), why.alias("diagnostic"))


def json_guarded_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", guards.counter(guards.native("props", "$.k")).alias("k"))


def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an error message."""
    rows = tx.with_classification(_table(spark, sf_dir, "documents"), F.col("source"), F.lit(None).cast("string"), F.col("text"))
    return rows.select("doc_id", "error_kind", "retryable", tx.http_status(F.col("text")).alias("http_status"))


def tool_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each kind of tool; event types stand for tool names."""
    name = F.when(F.col("event_type") == "click", " Bash").when(F.col("event_type") == "view", "READ_FILE").when(F.col("event_type") == "purchase", "apply_patch").otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").groupBy(tx.tool_kind(name).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def chain_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts continue in the part of half their key."""
    nodes = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = nodes.select(F.col("node").alias("src"), F.floor(F.col("node") / 2).alias("dst")).filter("src % 97 <> 5")
    return relations.resolve_chains(nodes, edges)


QUERIES = {
    f.__name__: f
    for f in (usage_turn_residuals, usage_residual_vs_rollup, record_reconcile, normalise_inclusive, cost_groups, by_model_slices, nearest_index_p95, perf_rates, json_guarded_int, error_classify, tool_classify, chain_resolve)
}


def _c(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


_RESIDUAL = f"""
d AS (SELECT o_custkey AS session, l_orderkey AS turn_id, CAST(sum({_c('l_extendedprice')}) AS BIGINT) AS detail, count(*) AS n_details FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
i AS (SELECT o_custkey AS session, o_orderkey AS turn_id, max({_c('o_totalprice')}) AS interval FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
r AS (SELECT coalesce(d.session, i.session) AS session, coalesce(d.turn_id, i.turn_id) AS turn_id, n_details, detail, interval, coalesce(detail > interval, FALSE) AS conflicted,
      CASE WHEN NOT coalesce(detail > interval, FALSE) THEN interval - coalesce(detail, 0) END AS residual, CASE WHEN NOT coalesce(detail > interval, FALSE) THEN coalesce(interval, detail) END AS known
      FROM d FULL JOIN i ON d.session = i.session AND d.turn_id = i.turn_id)"""


def _holds(markers: tuple[str, ...], text: str = "x") -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in markers) + ")"


def _code(*codes: str) -> str:
    return "(" + " OR ".join(f"contains(' ' || x || ' ', ' {c} ')" for c in codes) + ")"


_CASES = [
    (_holds(tx.REFUSALS), "unknown"), (_holds(tx.INTERRUPTS), "user_interrupt"), (_holds(tx.QUOTAS), "quota_exhausted"), (_holds(tx.RATES), "rate_limited"), (f"{_code('401', '403')} OR {_holds(tx.AUTHS)}", "auth"),
    (_holds(tx.CONTEXTS), "context_length"), (_holds(tx.OVERLOADS), "provider_overloaded"), (_holds(tx.POLICIES), "policy_blocked"), (_holds(tx.TIMEOUTS), "timeout"), (_holds(tx.RETRIES), "final"), (_holds(tx.TOOLS), "tool_error"),
    (_holds(tx.CRASHES), "runtime_crash"), (f"regexp_matches(x, '(^|[^0-9])(400|404|422)([^0-9]|$)') OR {_holds(tx.BAD_REQUESTS)}", "final"), (_holds(("apierror", "providererror"), "translate(x, '_- ', '')"), "provider_error"),
    (_code("500", "502", "503", "504", "522", "524"), "provider_error"), (_holds(tx.PROVIDERS), "provider_error"),
]

ORACLES = {
    "usage_turn_residuals": f"WITH {_RESIDUAL} SELECT session, turn_id, n_details, detail, interval, conflicted, residual, known FROM r",
    "usage_residual_vs_rollup": f"""WITH {_RESIDUAL},
        s AS (SELECT session, CAST(sum(detail) AS BIGINT) AS detail_total, CAST(sum(residual) AS BIGINT) AS residual_total, CAST(sum(known) AS BIGINT) AS known_total, count(*) FILTER (conflicted) AS nc, count(*) FILTER (interval IS NULL) AS ng FROM r GROUP BY session),
        t AS (SELECT o_custkey AS session, CAST(sum({_c('o_totalprice')}) AS BIGINT) AS complete_total FROM orders GROUP BY 1),
        b AS (SELECT coalesce(s.session, t.session) AS session, detail_total, residual_total, known_total, complete_total, nc, ng, complete_total - coalesce(known_total, 0) AS l FROM s FULL JOIN t ON s.session = t.session)
        SELECT session, detail_total, residual_total, known_total, complete_total, CASE WHEN l >= 0 THEN l END AS unattributed, coalesce(nc, 0) AS n_conflicts,
        CASE WHEN known_total IS NULL AND complete_total IS NULL THEN 'not_recorded' WHEN nc > 0 OR l < 0 THEN 'conflicted' WHEN complete_total IS NULL OR ng > 0 OR l <> 0 THEN 'partial' ELSE 'complete' END AS coverage, coalesce(complete_total, known_total) AS reported_total FROM b""",
    "record_reconcile": f"""WITH o AS (SELECT l_suppkey AS session, l_orderkey * 10 + l_linenumber AS pos, l_linenumber AS model, CAST(l_quantity AS BIGINT) AS i, CASE WHEN l_tax > 0.02::DOUBLE THEN {_c('l_discount')} END AS o,
          CASE WHEN l_returnflag = 'R' THEN 'response|' || l_partkey WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'turn|' || l_partkey ELSE 'record|' || (l_orderkey * 10 + l_linenumber) END AS record_key FROM lineitem),
        g AS (SELECT session, record_key, count(*) AS n_members, count(DISTINCT (coalesce(i, -1), coalesce(o, -1))) AS k, min(pos) AS first_pos, max(pos) AS last_pos, arg_min(model, pos) AS model, max_by(struct_pack(i := i, o := o), pos) AS l FROM o GROUP BY ALL)
        SELECT session, record_key, n_members, first_pos, last_pos, model, CASE WHEN n_members = 1 THEN 'single' WHEN k = 1 THEN 'equal' WHEN record_key LIKE 'turn|%' THEN 'latest' ELSE 'conflicted' END AS confidence,
        CASE WHEN n_members = 1 OR k = 1 OR record_key LIKE 'turn|%' THEN l.i END AS input_tokens, CASE WHEN n_members = 1 OR k = 1 OR record_key LIKE 'turn|%' THEN l.o END AS output_tokens FROM g""",
    "normalise_inclusive": f"""WITH o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) END AS a, CASE WHEN l_discount > 0 THEN {_c('l_discount')} END AS b, CASE WHEN l_tax > 0 THEN {_c('l_tax')} END AS c, CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS BIGINT) END AS o FROM lineitem),
        t AS (SELECT *, CASE WHEN coalesce(a, b, c) IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) END AS input_total FROM o) SELECT l_orderkey, l_linenumber, input_total, input_total + o AS total_tokens FROM t""",
    "cost_groups": f"SELECT l_returnflag AS currency, l_linestatus AS basis, CAST(sum(CASE WHEN l_tax > 0 THEN {_c('l_extendedprice')} END) AS BIGINT) AS cost, count(CASE WHEN l_tax > 0 THEN 1 END) AS n_costs, count(CASE WHEN l_tax > 0 THEN NULL ELSE 1 END) AS n_missing FROM lineitem GROUP BY 1, 2",
    "by_model_slices": f"""WITH s AS (SELECT CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS model, CAST(sum({_c('l_extendedprice')}) AS BIGINT) AS amount, count(*) AS n_rows FROM lineitem GROUP BY 1)
        SELECT model, amount, n_rows, CAST(greatest((SELECT count(*) FROM s) - 50, 0) AS BIGINT) AS omitted FROM s ORDER BY coalesce(CAST(model AS VARCHAR), 'None') LIMIT 50""",
    "nearest_index_p95": """WITH l AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
        SELECT event_type, n, v[CAST(least(floor(n * 0.95::DOUBLE), n - 1) AS BIGINT) + 1] AS p95, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 AS median FROM l""",
    "perf_rates": """WITH r AS (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS e, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY 1),
        b AS (SELECT l_orderkey, tokens, e, epoch_us(o_orderdate) AS s, CASE WHEN e > epoch_us(o_orderdate) THEN (e - epoch_us(o_orderdate)) / 1000.0::DOUBLE END AS ms FROM r LEFT JOIN orders ON l_orderkey = o_orderkey)
        SELECT l_orderkey, tokens, ms AS duration_ms, tokens * 1000 / ms AS tokens_per_second, CASE WHEN s IS NULL THEN 'missing_request' WHEN e < s THEN 'clock_reversal' WHEN ms IS NULL THEN 'empty' END AS diagnostic FROM b""",
    "json_guarded_int": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "error_classify": f"""WITH t AS (SELECT doc_id, text, lower(concat_ws(' ', trim(coalesce(source, '')), '', coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT doc_id, text, CASE {' '.join(f"WHEN {test} THEN '{name}'" for test, name in _CASES)} ELSE 'unknown' END AS k FROM t)
        SELECT doc_id, CASE k WHEN 'final' THEN 'provider_error' ELSE k END AS error_kind, CASE WHEN k IN ('rate_limited', 'provider_overloaded', 'provider_error', 'timeout') THEN TRUE WHEN k IN ('runtime_crash', 'unknown') THEN NULL ELSE FALSE END AS retryable,
        CAST(nullif(regexp_extract(text, '(^|[^0-9])([1-5][0-9]{{2}})([^0-9]|$)', 2), '') AS INTEGER) AS http_status FROM c""",
    "tool_classify": "SELECT CASE event_type WHEN 'click' THEN 'shell' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'edit' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "chain_resolve": """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey % 97 <> 5 AND p_partkey <> p_partkey // 2 AND p_partkey // 2 IN (SELECT p_partkey FROM part)),
        w AS (SELECT p_partkey AS node, p_partkey AS cur, 0 AS hops FROM part UNION ALL SELECT node, dst, hops + 1 FROM w JOIN e ON w.cur = e.src)
        SELECT node, arg_max(cur, hops) AS target, max(hops) AS hops FROM w GROUP BY node""",
}
