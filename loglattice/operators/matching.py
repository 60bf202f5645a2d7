"""Which result belongs to which call: stacks, queues and reused ids without a walk over the session.

A call opens, a result closes.  The number of calls minus that of results so far is
a height, a running sum in buckets.  A stack's call that lifts the height to a level
is taken by the next result that lowers it from there, and at each level calls and
results take turns, so the k-th call of a level meets its k-th result: an equal join
by (level, k), written as a grouping.  A result that lowers the height to where it
never was finds nothing open; at levels of zero and below that is the first result,
so the others move up by one.  In a queue the k-th call meets the k-th result that
finds something open.  All counts are two-level scans, so a session with a third of
all rows is many tasks.

Defined results: a null session is a session; rows that are neither call nor result
are left out; an empty id is no id; two rows with the same ``seq`` come in any order;
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators.ordered import BUCKET, running_sum, with_repeats


def _levels(rows: DataFrame, keys: list[str], seq: str, bucket: int) -> DataFrame:
    """``rows`` (with ``opens``) and the ``level`` that each crosses, its number ``nth`` among the like at that level, and whether a result finds nothing ``lost``."""
    high = running_sum(rows, keys, seq, F.when(F.col("opens"), 1).otherwise(-1), "height", bucket)
    high = high.withColumn("level", F.when(F.col("opens"), F.col("height")).otherwise(F.col("height") + 1)).drop("height")
    counted = running_sum(high, [*keys, "level", "opens"], seq, F.lit(1), "nth", bucket)
    return counted.withColumn("lost", ~F.col("opens") & (F.col("level") <= 0) & (F.col("nth") == 1))


def _met(rows: DataFrame, keys: list[str], by: list[Column], seq: str, more: list[str]) -> DataFrame:
    """One row for each call and result that have the same key; ``more`` columns are the result's."""
    opens, closes = F.max(F.when(F.col("opens"), F.col(seq))), F.max(F.when(~F.col("opens"), F.col(seq)))
    carried = [F.max(F.when(~F.col("opens"), F.struct(*[F.col(c).alias(c) for c in more]))).alias("_more")] if more else []
    met = rows.groupBy(*keys, *by).agg(opens.alias("call_seq"), closes.alias("result_seq"), *carried)
    return met.select(*keys, "call_seq", "result_seq", *[F.col(f"_more.{c}").alias(c) for c in more])


def stack_pairs(rows: DataFrame, keys: list[str], seq: str = "seq", more: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """``keys, call_seq, result_seq`` where each result takes the latest open call; what finds no partner stands alone.

    ``rows`` has a boolean ``opens``; ``more`` are columns of the result to carry along.
    """
    found = _levels(rows, keys, seq, bucket)
    nth = F.when(~F.col("opens") & (F.col("level") <= 0), F.col("nth") - 1).otherwise(F.col("nth"))
    return _met(found, keys, [F.col("level"), nth.alias("_n"), F.col("lost")], seq, more or [])


def queue_pairs(rows: DataFrame, keys: list[str], seq: str = "seq", more: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """``keys, call_seq, result_seq`` where each result takes the earliest open call."""
    found = _levels(rows, keys, seq, bucket)
    found = running_sum(found, [*keys, "lost", "opens"], seq, F.lit(1), "place", bucket)
    return _met(found, keys, [F.col("place"), F.col("lost")], seq, more or [])


def in_order(events: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``session, call_id, call_seq, result_seq`` of all calls and results, where ids repeat, are empty or unknown.

    A result takes the open call of its id; without an id, or when no call of its id
    is open, the latest open call without an id; else it stays alone.  A call whose
    id is still open isn't registered.  So among the rows of one id the first call of
    a run of calls meets the first result of the run after it.
    """
    call = F.col("type") == "tool_call"
    rows = events.filter(F.col("type").isin("tool_call", "tool_result"))
    rows = rows.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.nullif(F.col("call_id").cast("string"), F.lit("")).alias("call_id"), call.alias("opens"))
    keyed = with_repeats(rows.filter("call_id is not null"), ["session", "call_id"], "seq", ["opens"], "again", bucket)
    heads = running_sum(keyed.filter("not again"), ["session", "call_id"], "seq", F.lit(1), "n", bucket)
    met = _met(heads, ["session", "call_id"], [F.when(F.col("opens"), F.col("n")).otherwise(F.col("n") - 1).alias("_n")], "seq", [])
    paired = met.filter("call_seq is not null").unionByName(keyed.filter("again and opens").select("session", "call_id", F.col("seq").alias("call_seq"), F.lit(None).cast("long").alias("result_seq")))
    unknown = met.filter("call_seq is null").select("session", F.col("result_seq").alias("seq"), "call_id", F.lit(False).alias("opens"))
    unknown = unknown.unionByName(keyed.filter("again and not opens").select("session", "seq", "call_id", "opens"))
    loose = rows.filter("call_id is null").select("session", "seq", "call_id", "opens").unionByName(unknown)
    return paired.unionByName(stack_pairs(loose, ["session"], more=["call_id"], bucket=bucket).select(*paired.columns))
