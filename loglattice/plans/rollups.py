"""Queries over session counters: ``events`` give rollups that stand alone, agree, add up or contradict, and the records beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import rollups

METRICS = ("input_total", "output_total", "total_tokens")


def session_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbouring events are a session; by its number it has one rollup, equal ones, parts by model, or counters that don't fit together."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 5).alias("n"), F.col("event_id").alias("pos"), (F.col("event_id") % 5).alias("k"))
    n, k, pos = F.col("n"), F.col("k"), F.col("pos")
    parts = n % 8 >= 3
    value = lambda many, few: F.when(parts, many).otherwise(few)
    rows = rows.filter((k == 0) | (n % 8 != 0))
    return rows.select(
        F.concat(F.lit("r"), n.cast("string")).alias("session"), "pos", F.when(parts, F.when(k != 4, F.concat(F.lit("m"), (k % 3).cast("string")))).otherwise("m").alias("model"), F.lit("p").alias("provider"),
        F.when((n % 8 == 7) & (k == 3), "absolute").otherwise("cumulative").alias("counter_kind"), F.lit("tokens").alias("counter_name"),
        value(F.when((n % 8 != 4) | (k != 2), k % 3 * 10 + n), F.when((n % 8 == 2) & (k == 1), 1).otherwise(n)).cast("long").alias("input_total"), value(k % 3, n % 7).cast("long").alias("output_total"),
        F.when(n % 16 != 5, value(k % 3 * 11 + n, n * 2)).cast("long").alias("total_tokens"),
        F.when((n % 16 != 11) | (k != 4), 0.25).alias("cost"), F.when((n % 8 == 6) & (k % 3 == 1), "EUR").otherwise("USD").alias("currency"), F.lit("native").alias("cost_basis"),
    )


def rollups_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.combine(session_rollups(spark, sf_dir), METRICS)


def usage_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clicks are details and purchases intervals of turns of thirty events of a user, errors rollups; signups are there without a record."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("pos"), F.floor(F.col("event_id") / 2000).alias("turn_id"), "event_type")
    pos = F.col("pos")
    records = rows.filter("event_type in ('click', 'purchase')").groupBy("session", "turn_id", "event_type").agg(F.min("pos").alias("pos"))
    interval = F.col("event_type") == "purchase"
    records = records.select(
        "session", "turn_id", F.when(interval, "interval").otherwise("detail").alias("kind"), (interval & (pos % 9 == 0)).alias("unresolved"),
        F.when(interval, 100 + pos % 50).otherwise(pos % 120).alias("input_total"), F.when(pos % 7 != 0, pos % 5).alias("output_total"), F.when(F.col("session") % 11 != 0, F.when(interval, 200).otherwise(pos % 120)).cast("long").alias("total_tokens"),
    )
    tops = rows.filter("event_type = 'error' and session % 3 <> 0").groupBy("session").agg(F.min("pos").alias("pos"))
    known = records.filter("not unresolved").groupBy("session").agg(F.sum("total_tokens").alias("t"))
    tops = tops.join(known, "session", "left").select(
        "session", "pos", F.lit("m").alias("model"), F.lit("p").alias("provider"), F.lit("cumulative").alias("counter_kind"), F.lit("tokens").alias("counter_name"),
        (pos % 4000).alias("input_total"), F.lit(None).cast("long").alias("output_total"), F.coalesce("t", F.lit(0)).alias("total_tokens"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("cost_basis"),
    )
    return records, rollups.combine(tops, METRICS), rows.select("session").distinct()


def usage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, tops, _ = usage_records(spark, sf_dir)
    return rollups.coverage(records, tops, METRICS, F.col("session") % 13 != 0)


def usage_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, tops, sessions = usage_records(spark, sf_dir)
    supported = F.col("session") % 13 != 0
    return rollups.overall(rollups.coverage(records, tops, METRICS, supported), tops, sessions, supported)


QUERIES = {f.__name__: f for f in (rollups_combined, usage_coverage, usage_overall)}

_COVERAGE = """
e AS (SELECT CAST(user_id AS VARCHAR) AS session, user_id AS u, event_id AS pos, CAST(floor(event_id / 2000) AS BIGINT) AS turn_id, event_type AS k FROM events),
g AS (SELECT session, u, turn_id, k, min(pos) AS pos FROM e WHERE k IN ('click', 'purchase') GROUP BY ALL),
rec AS (SELECT session, turn_id, k = 'purchase' AS iv, k = 'purchase' AND pos % 9 = 0 AS un, CASE k WHEN 'purchase' THEN 100 + pos % 50 ELSE pos % 120 END AS i, CASE WHEN pos % 7 <> 0 THEN pos % 5 END AS o,
        CASE WHEN u % 11 <> 0 THEN CASE k WHEN 'purchase' THEN 200 ELSE pos % 120 END END AS t FROM g),
top AS (SELECT e.session, min(pos) % 4000 AS i, NULL::BIGINT AS o, coalesce(any_value(x.t), 0) AS t FROM e LEFT JOIN (SELECT session, sum(t) AS t FROM rec WHERE NOT un GROUP BY session) x ON x.session = e.session WHERE k = 'error' AND u % 3 <> 0 GROUP BY e.session),
l AS (SELECT session, turn_id, iv, un, 'input_total' AS metric, i AS v FROM rec UNION ALL SELECT session, turn_id, iv, un, 'output_total', o FROM rec UNION ALL SELECT session, turn_id, iv, un, 'total_tokens', t FROM rec),
tl AS (SELECT session, 'input_total' AS metric, i AS c FROM top UNION ALL SELECT session, 'output_total', o FROM top UNION ALL SELECT session, 'total_tokens', t FROM top),
tt AS (SELECT session, metric, turn_id, sum(v) FILTER (NOT iv) AS d, max(v) FILTER (iv) AS i FROM l GROUP BY ALL HAVING NOT bool_or(un)),
s AS (SELECT session, metric, CAST(sum(d) FILTER (NOT coalesce(d > i, false)) AS BIGINT) AS d, CAST(sum(i - coalesce(d, 0)) FILTER (NOT coalesce(d > i, false)) AS BIGINT) AS i, bool_or(coalesce(d > i, false)) AS ov FROM tt GROUP BY ALL),
b AS (SELECT coalesce(s.session, tl.session) AS session, coalesce(s.metric, tl.metric) AS metric, d, i, coalesce(ov, false) AS ov, c, CASE WHEN d IS NOT NULL OR i IS NOT NULL THEN coalesce(d, 0) + coalesce(i, 0) END AS kn FROM s FULL JOIN tl ON s.session = tl.session AND s.metric = tl.metric),
cov AS (SELECT session, metric, kn AS known_total, d AS detail_total, i AS interval_total, CAST(CASE WHEN coalesce(c - kn >= 0, true) THEN c END AS BIGINT) AS complete_total, CAST(CASE WHEN NOT ov AND c - kn >= 0 THEN c - kn END AS BIGINT) AS unattributed,
        CASE WHEN CAST(session AS BIGINT) % 13 = 0 THEN 'unsupported' WHEN ov OR coalesce(c - kn < 0, false) THEN 'conflicted' WHEN c IS NOT NULL OR kn IS NOT NULL THEN 'partial' ELSE 'unknown' END AS coverage FROM b)"""

ORACLES = {
    "rollups_combined": """
WITH e AS (SELECT CAST(floor(event_id / 5) AS BIGINT) AS n, event_id AS pos, event_id % 5 AS k FROM events),
r AS (SELECT n, pos, CASE WHEN n % 8 >= 3 THEN CASE WHEN k <> 4 THEN 'm' || (k % 3) END ELSE 'm' END AS model, CASE WHEN n % 8 = 7 AND k = 3 THEN 'absolute' ELSE 'cumulative' END AS ck,
             CASE WHEN n % 8 >= 3 THEN CASE WHEN n % 8 <> 4 OR k <> 2 THEN k % 3 * 10 + n END WHEN n % 8 = 2 AND k = 1 THEN 1 ELSE n END AS i, CASE WHEN n % 8 >= 3 THEN k % 3 ELSE n % 7 END AS o,
             CASE WHEN n % 16 <> 5 THEN CASE WHEN n % 8 >= 3 THEN k % 3 * 11 + n ELSE n * 2 END END AS t, CASE WHEN n % 16 <> 11 OR k <> 4 THEN 0.25::DOUBLE END AS c, CASE WHEN n % 8 = 6 AND k % 3 = 1 THEN 'EUR' ELSE 'USD' END AS cur FROM e WHERE k = 0 OR n % 8 <> 0),
p AS (SELECT n, model, ck, count(*) AS cnt, count(DISTINCT (i, o, t, c, cur)) = 1 AS ag, arg_min((i, o, t, c, cur), pos) AS f, min(pos) AS pos FROM r GROUP BY ALL),
s AS (SELECT n, count(*) AS np, sum(cnt) AS nr, bool_and(ag) AS ag, bool_and(ck = 'cumulative') AS ad, arg_min(f, pos) AS f, CASE WHEN count(f[1]) = count(*) THEN sum(f[1]) END AS i, CASE WHEN count(f[2]) = count(*) THEN sum(f[2]) END AS o, CASE WHEN count(f[3]) = count(*) THEN sum(f[3]) END AS t,
             CASE WHEN count(DISTINCT f[5]) = 1 AND count(f[4]) = count(*) THEN sum(f[4]) END AS c, min(f[5]) AS cur, count(f[1]) AS ci, count(f[3]) AS ct, count(f[4]) AS cc FROM p GROUP BY n),
v AS (SELECT *, CASE WHEN NOT ag OR (np > 1 AND NOT ad) THEN 'conflict' WHEN np > 1 THEN 'combined' WHEN nr > 1 THEN 'agree' ELSE 'single' END AS vd FROM s)
SELECT 'r' || n AS session, CAST(nr AS BIGINT) AS n_rollups, vd AS verdict, CAST(CASE vd WHEN 'combined' THEN i WHEN 'conflict' THEN NULL ELSE f[1] END AS BIGINT) AS input_total, CAST(CASE vd WHEN 'combined' THEN o WHEN 'conflict' THEN NULL ELSE f[2] END AS BIGINT) AS output_total,
       CAST(CASE vd WHEN 'combined' THEN t WHEN 'conflict' THEN NULL ELSE f[3] END AS BIGINT) AS total_tokens, CASE vd WHEN 'combined' THEN c WHEN 'conflict' THEN NULL ELSE f[4] END AS cost, CASE vd WHEN 'combined' THEN CASE WHEN c IS NOT NULL THEN cur END WHEN 'conflict' THEN NULL ELSE f[5] END AS currency,
       CASE vd WHEN 'combined' THEN CASE WHEN c IS NOT NULL THEN 'native' ELSE 'unknown' END WHEN 'conflict' THEN NULL ELSE 'native' END AS cost_basis,
       CASE WHEN vd = 'combined' THEN array_to_string(list_filter([CASE WHEN c IS NULL AND cc > 0 THEN 'rollup.cost' END, CASE WHEN i IS NULL AND ci > 0 THEN 'rollup.input_total' END, CASE WHEN t IS NULL AND ct > 0 THEN 'rollup.total_tokens' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS gaps FROM v
""",
    "usage_coverage": f"WITH {_COVERAGE} SELECT * FROM cov",
    "usage_overall": f"""WITH {_COVERAGE},
a AS (SELECT session, bool_or(coverage = 'conflicted') AS cl, max(CASE WHEN metric = 'total_tokens' AND complete_total IS NOT NULL THEN unattributed END) AS lf FROM cov GROUP BY session)
SELECT x.session, CASE WHEN CAST(x.session AS BIGINT) % 13 = 0 THEN 'unsupported' WHEN a.session IS NULL THEN 'not_recorded' WHEN cl THEN 'conflicted' WHEN top.session IS NOT NULL AND lf = 0 THEN 'complete' ELSE 'partial' END AS coverage
FROM (SELECT DISTINCT session FROM e) x LEFT JOIN a ON a.session = x.session LEFT JOIN top ON top.session = x.session""",
}
