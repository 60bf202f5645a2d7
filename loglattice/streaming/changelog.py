"""Continuous queries: session windows, and a keyed changelog that may be delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: The lateness that session windows wait for; the sources themselves order by position.
LATENESS = "10 minutes"


def session_activity(stream: DataFrame, session: str = "user_id", ts: str = "ts", gap: str = "300 seconds") -> DataFrame:
    """``session, started, ended, n``: the gap sessions of a stream (or a batch) of activity."""
    timed = stream.select(F.col(session).alias("session"), F.col(ts).cast("timestamp").alias("t"))
    held = timed.withWatermark("t", LATENESS) if stream.isStreaming else timed
    grouped = held.groupBy("session", F.session_window("t", gap).alias("w")).agg(F.min("t").alias("started"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    return grouped.select("session", "started", (F.col("last") + F.expr("INTERVAL 60 SECONDS")).alias("ended"), "n")


def coalesced(records: DataFrame) -> DataFrame:
    """The latest record of each ``session, key`` by ``generation, pos``; a removal is a record with ``op = 'remove'``."""
    rest = [c for c in records.columns if c not in ("session", "key")]
    latest = records.groupBy("session", "key").agg(F.max_by(F.struct(*rest), F.struct("generation", "pos")).alias("r"))
    return latest.select("session", "key", *[f"r.{c}" for c in rest])


def appended(records: DataFrame) -> DataFrame:
    """Values of ``append`` records joined to what stands before them in a key.

    ``upsert`` replaces, ``append`` continues.  Appends without anything before
    them are a gap: they are kept and flagged.
    """
    base = records.filter("op = 'upsert'").groupBy("session", "key", "generation").agg(F.max("pos").alias("base_pos"))
    live = records.join(base, ["session", "key", "generation"], "left").filter(F.col("base_pos").isNull() | (F.col("pos") >= F.col("base_pos")))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    return live.groupBy("session", "key", "generation").agg(parts.alias("text"), F.max("pos").alias("pos"), F.max("base_pos").isNull().alias("gap"))


def changelog(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of each batch's latest records to ``folder/batch=N``.

    A batch that is run again replaces its own folder, so delivery twice leaves
    one copy; :func:`state_of` reads the current state.
    """

    def put(batch: DataFrame, number: int) -> None:
        coalesced(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def state_of(log: DataFrame) -> DataFrame:
    """The live keys of a changelog: records of a session's newest generation that aren't removed."""
    newest = log.groupBy("session").agg(F.max("generation").alias("generation"))
    return coalesced(log.drop("batch").join(newest, ["session", "generation"], "left_semi")).filter("op <> 'remove'")
