"""Queries over files that grow and sessions that are still running.

``events`` rows are written as session files of JSON lines, or as operations of a
live feed: clicks set a key, views and purchases continue it, signups take it
away, and some errors reset the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import intervals as iv
from loglattice.plans.ledger import SINCE, UNTIL
from loglattice.sources import growing
from loglattice.sources.shared import fresh, settle
from loglattice.streaming import framing, live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _write_files(rows: DataFrame, order: list[str], folder: str) -> None:
    """A file for each user, whose lines are in ``order``; users without an id are one."""
    name = F.concat(F.lit("user_id="), F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit(".txt"))
    growing.write_files(rows.repartition("user_id").sortWithinPartitions("user_id", *order).select(name.alias("name"), "line"), folder)


def _session() -> Column:
    return F.nullif(F.regexp_extract("path", "user_id=(-?[0-9]*)", 1), F.lit("")).cast("long")


def session_files_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of one file for each session, read by byte ranges and numbered: its place, its bytes, what it holds and whether it is well formed."""
    line = F.when(F.col("event_type") == "error", F.lit("{broken")).when(F.col("event_type") == "signup", F.lit("[1]")).otherwise(F.to_json(F.struct("event_id", "event_type", "k")))
    rows = _events(spark, sf_dir).select("user_id", "event_id", line.alias("line"))
    folder = fresh(spark, "session-files")
    _write_files(rows, ["event_id"], folder)
    lines = growing.numbered(settle(growing.read(spark, folder, pattern="*.txt", rangeBytes=1 << 20), "session-lines"), 1 << 20)
    return lines.select(
        _session().alias("session"), "pos", "start", growing.line_state(F.col("raw")).alias("state"),
        F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"), F.get_json_object("raw", "$.event_type").alias("event_type"),
    )


def window_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a week in January 2024, from session files of which an index of their blocks' times tells what to read."""
    ts = iv.micros("ts")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", ts.alias("t"), F.to_json(F.struct("event_id", ts.alias("t"))).alias("line"))
    folder, index = fresh(spark, "session-files"), fresh(spark, "session-index")
    _write_files(rows, ["t", "event_id"], folder)
    micros = F.get_json_object("raw", "$.t").cast("long")
    growing.build_index(growing.read(spark, folder, pattern="*.txt"), micros, index, block=1 << 12)
    lines = growing.read_window(spark, folder, index, SINCE, UNTIL, pattern="*.txt").filter(micros.between(SINCE, UNTIL))
    return lines.select(_session().alias("session"), F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"), micros.alias("t"))


def feed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of feeds, one for each user: an event is two lines of data, errors have none, and every seventh frame isn't ended by itself."""
    rows = _events(spark, sf_dir)
    lines = F.array(F.concat(F.lit("event: "), F.col("event_type")), F.when(F.col("event_type") != "error", F.lit('data: {"k":')).otherwise(": none"), F.when(F.col("event_type") != "error", F.concat(F.lit("data:"), F.col("k"), F.lit("}"))), F.when(F.col("event_id") % 7 != 0, ""))
    spread = rows.select(F.col("user_id").alias("session"), "event_id", F.posexplode(lines).alias("at", "raw")).filter("raw is not null")
    return framing.frames(spread.select("session", (F.col("event_id") * 10 + F.col("at")).alias("pos"), "raw"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "click", "upsert").when(kind.isin("view", "purchase"), "append").when(kind == "signup", "remove").when(F.col("k") % 10 == 0, "reset").otherwise("upsert")
    text = F.concat_ws("", F.lit(";"), F.col("event_id"))
    none = F.lit(None)
    return _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("pos"), none.cast("string").alias("event_id"), op.alias("op"), F.concat(F.lit("k"), F.col("k") % 7).alias("key"), kind.alias("kind"), text.alias("text"), none.cast("long").alias("offset"), none.cast("boolean").alias("complete"))


def live_state_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every session shows in the end, from its operations as a table."""
    return live.state(live.replay(operations(spark, sf_dir))).select("session", "key", "kind", "text")


def live_state_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that stops half way, goes on from its checkpoint, and gets the last operations of the first half twice."""
    rows, feed, out, checkpoint = operations(spark, sf_dir), fresh(spark, "feed"), fresh(spark, "records"), fresh(spark, "feed-checkpoint")
    last = rows.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for lower, upper in ((-1, last // 2), (last // 3, last)):
            rows.filter(F.col("pos").between(lower, upper)).write.mode("append").parquet(feed)
            query = live.follow_to(spark.readStream.schema(rows.schema).parquet(feed), out, checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return live.state(spark.read.schema(live.RECORDS).parquet(out)).select("session", "key", "kind", "text")


QUERIES = {f.__name__: f for f in (session_files_by_range, window_by_index, feed_frames, live_state_replayed, live_state_streamed)}

_STATE = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS pos, event_type AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
o AS (SELECT session, pos, kind, 'k' || (k % 7) AS key, ';' || pos AS t,
             CASE WHEN kind = 'click' THEN 'upsert' WHEN kind IN ('view', 'purchase') THEN 'append' WHEN kind = 'signup' THEN 'remove' WHEN k % 10 = 0 THEN 'reset' ELSE 'upsert' END AS op FROM e),
r AS (SELECT *, coalesce(max(CASE WHEN op = 'reset' THEN pos END) OVER (PARTITION BY session), -1) AS reset_pos FROM o),
b AS (SELECT *, coalesce(max(CASE WHEN op IN ('upsert', 'remove') THEN pos END) OVER (PARTITION BY session, key), -1) AS base_pos FROM r WHERE op <> 'reset' AND pos > reset_pos)
SELECT session, key, max_by(kind, pos) AS kind, string_agg(t, '' ORDER BY pos) AS text FROM b WHERE pos >= base_pos AND op <> 'remove' GROUP BY session, key
"""

ORACLES = {
    "session_files_by_range": """
WITH l AS (SELECT user_id AS session, event_id, event_type,
                  CASE event_type WHEN 'error' THEN '{broken' WHEN 'signup' THEN '[1]' ELSE '{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS INTEGER) || '}' END AS line FROM events)
SELECT session, row_number() OVER w AS pos, CAST(coalesce(sum(strlen(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CASE event_type WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'non_object' ELSE 'ok' END AS state,
       CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE event_id END AS event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE event_type END AS event_type
FROM l WINDOW w AS (PARTITION BY session ORDER BY event_id)
""",
    "window_by_index": f"SELECT user_id AS session, event_id, epoch_us(ts) AS t FROM events WHERE epoch_us(ts) BETWEEN {SINCE} AND {UNTIL}",
    "feed_frames": """
WITH e AS (SELECT user_id AS session, event_id, event_type <> 'error' AS d, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id % 7 <> 0 AS b FROM events),
g AS (SELECT *, coalesce(sum(b::INT) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM e)
SELECT session, max(event_id) FILTER (b) * 10 + 3 AS pos, string_agg('{"k":' || chr(10) || k || '}', chr(10) ORDER BY event_id) FILTER (d) AS raw, CASE WHEN count(*) FILTER (d) = 1 THEN 'ok' ELSE 'malformed' END AS state
FROM g GROUP BY session, f HAVING bool_or(b) AND bool_or(d)
""",
    "live_state_replayed": _STATE,
    "live_state_streamed": _STATE,
}
