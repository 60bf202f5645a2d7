"""Active-time queries: users are sessions and event types are projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import intervals as iv
from loglattice.operators.ordered import carry_forward, drop_repeats, running_sum

#: A week in January 2024, in microseconds.
SINCE, UNTIL = 1_704_585_600_000_000, 1_705_190_400_000_000


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", iv.micros("ts").alias("t"))


def active_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.active_intervals(stamps(spark, sf_dir), ["user_id"]).withColumnRenamed("n", "activity_count")


def active_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.ledger(iv.active_intervals(stamps(spark, sf_dir), ["user_id"]), ["user_id"])


def active_ledger_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.ledger(iv.active_intervals(stamps(spark, sf_dir), ["user_id"], gap=iv.HOUR), ["user_id"])


def active_ledger_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.ledger(iv.active_intervals(stamps(spark, sf_dir), ["event_type"]), ["event_type"])


def clipped_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only events within the window (both ends), then intervals cut to it."""
    inside = stamps(spark, sf_dir).filter(F.col("t").between(SINCE, UNTIL))
    return iv.ledger(iv.clip(iv.active_intervals(inside, ["user_id"]), SINCE, UNTIL), ["user_id"])


def _by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.active_intervals(stamps(spark, sf_dir), ["event_type", "user_id"], gap=iv.HOUR)


def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.project_rollup(_by_project(spark, sf_dir), "event_type", "user_id")


def union_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union_length(_by_project(spark, sf_dir), ["event_type"])


def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.peak_concurrency(iv.active_intervals(stamps(spark, sf_dir), ["user_id"], gap=iv.HOUR), [])


def weekday_hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.weekday_hours(iv.active_intervals(stamps(spark, sf_dir), ["user_id"], gap=iv.HOUR))


def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all sessions of the window."""
    book = iv.clip(iv.active_intervals(stamps(spark, sf_dir).filter(F.col("t").between(SINCE, UNTIL)), ["user_id"]), SINCE, UNTIL)
    per = book.groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("b") - F.col("a")).alias("d"))
    return per.agg(F.count(F.lit(1)).alias("session_count"), F.sum("n").alias("activity_count"), F.sum("k").alias("interval_count"), iv.seconds(F.sum("d")).alias("active_seconds"))


def token_window_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (whole values) of the window by model (event type); types without any are left out."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.floor("value").alias("tokens"), iv.micros("ts").alias("t"))
    sums = rows.filter(F.col("t").between(SINCE, UNTIL)).groupBy(F.col("event_type").alias("model")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    return sums.filter("tokens <> 0")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")


def context_model_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the context that the latest signup before it has set."""
    context = F.when(F.col("event_type") == "signup", F.floor("value"))
    return carry_forward(_log(spark, sf_dir), ["user_id"], "event_id", context, "context").drop("value")


def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(_log(spark, sf_dir), ["user_id"], "event_id", ["event_type"]).select("user_id", "event_id", "event_type")


def running_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many errors a user has had up to each event."""
    return running_sum(_log(spark, sf_dir), ["user_id"], "event_id", F.when(F.col("event_type") == "error", 1).otherwise(0), "errors").drop("value")


QUERIES = {
    f.__name__: f
    for f in (active_intervals, active_ledger, active_ledger_1h, active_ledger_by_type, clipped_ledger, project_rollup, union_seconds, peak_concurrency, weekday_hour_histogram, stats_totals, token_window_by_model, context_model_asof, consecutive_dedup, running_errors)
}


def _islands(keys: str, gap: int, where: str = "TRUE") -> str:
    return f"""
t AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events WHERE {where}),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) <= {gap} THEN 0 ELSE 1 END AS nw FROM t),
k AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g),
i AS (SELECT {keys}, min(t) AS a, max(t) + 60000000 AS b, count(*) AS n FROM k GROUP BY {keys}, k)"""


_WINDOW = f"epoch_us(ts) BETWEEN {SINCE} AND {UNTIL}"
_CLIP = f"c AS (SELECT user_id, n, greatest(a, {SINCE}) AS a, least(b, {UNTIL}) AS b FROM i WHERE least(b, {UNTIL}) > greatest(a, {SINCE}))"


def _book(keys: str, source: str = "i") -> str:
    return f"SELECT {keys}, CAST(sum(n) AS BIGINT) AS activity_count, count(*) AS interval_count, CAST(min(a) AS BIGINT) AS first_us, CAST(max(b) AS BIGINT) AS last_us, CAST(sum(b - a) AS BIGINT) / 1000000.0::DOUBLE AS active_seconds FROM {source} GROUP BY {keys}"


_UNION = """
m AS (SELECT event_type, a, b, max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
u AS (SELECT *, sum(CASE WHEN a <= p THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m),
un AS (SELECT event_type, CAST(sum(d) AS BIGINT) / 1000000.0::DOUBLE AS union_seconds FROM (SELECT event_type, k, max(b) - min(a) AS d FROM u GROUP BY event_type, k) GROUP BY event_type)"""


def _peak(keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    lead, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"""
d AS (SELECT {lead}a AS t, 1 AS d FROM i UNION ALL SELECT {lead}b AS t, -1 AS d FROM i),
o AS (SELECT {lead}t, sum(d) OVER ({part}ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS c FROM d),
x AS (SELECT {lead}max(c) AS peak FROM o{group}),
p AS (SELECT {lead and 'o.' + lead}CAST(x.peak AS BIGINT) AS peak, min(o.t) AS peak_at_us FROM o JOIN x ON o.c = x.peak{' AND o.' + keys + ' = x.' + keys if keys else ''} GROUP BY ALL)"""


ORACLES = {
    "active_intervals": f"WITH {_islands('user_id', 300000000)} SELECT user_id, a, b, n AS activity_count FROM i",
    "active_ledger": f"WITH {_islands('user_id', 300000000)} {_book('user_id')}",
    "active_ledger_1h": f"WITH {_islands('user_id', 3600000000)} {_book('user_id')}",
    "active_ledger_by_type": f"WITH {_islands('event_type', 300000000)} {_book('event_type')}",
    "clipped_ledger": f"WITH {_islands('user_id', 300000000, _WINDOW)}, {_CLIP} {_book('user_id', 'c')}",
    "union_seconds": f"WITH {_islands('event_type, user_id', 3600000000)}, {_UNION} SELECT * FROM un",
    "project_rollup": f"""WITH {_islands('event_type, user_id', 3600000000)}, {_UNION}, {_peak('event_type')},
        s AS (SELECT event_type, count(DISTINCT user_id) AS session_count, CAST(sum(n) AS BIGINT) AS activity_count, CAST(sum(b - a) AS BIGINT) / 1000000.0::DOUBLE AS active_seconds FROM i GROUP BY event_type)
        SELECT event_type AS project, session_count, activity_count, union_seconds, peak, peak_at_us, active_seconds FROM s JOIN un USING (event_type) JOIN p USING (event_type)""",
    "peak_concurrency": f"WITH {_islands('user_id', 3600000000)}, {_peak('')} SELECT peak, peak_at_us FROM p",
    "weekday_hour_histogram": f"""WITH {_islands('user_id', 3600000000)},
        h AS (SELECT a, b, unnest(generate_series(a // 3600000000, (b - 1) // 3600000000)) AS h FROM i),
        s AS (SELECT (h // 24 + 3) % 7 AS dow, h % 24 AS hour, sum(least(b, (h + 1) * 3600000000) - greatest(a, h * 3600000000)) AS d FROM h GROUP BY ALL)
        SELECT CAST(g // 24 AS INTEGER) AS dow, CAST(g % 24 AS INTEGER) AS hour, CAST(coalesce(d, 0) AS BIGINT) / 1000000.0::DOUBLE AS seconds
        FROM range(168) r(g) LEFT JOIN s ON s.dow = g // 24 AND s.hour = g % 24""",
    "stats_totals": f"""WITH {_islands('user_id', 300000000, _WINDOW)}, {_CLIP}
        SELECT count(DISTINCT user_id) AS session_count, CAST(sum(n) AS BIGINT) AS activity_count, count(*) AS interval_count, CAST(sum(b - a) AS BIGINT) / 1000000.0::DOUBLE AS active_seconds FROM c""",
    "token_window_by_model": f"SELECT event_type AS model, CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) AS n_rows FROM events WHERE {_WINDOW} GROUP BY event_type HAVING sum(floor(value)) <> 0",
    "context_model_asof": """SELECT user_id, event_id, event_type, CAST(last_value(CASE WHEN event_type = 'signup' THEN floor(value) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS context FROM events""",
    "consecutive_dedup": "SELECT user_id, event_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "running_errors": "SELECT user_id, event_id, event_type, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors FROM events",
}
