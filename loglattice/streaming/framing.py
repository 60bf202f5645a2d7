"""Events in the lines of a feed: one JSON object a line, or frames of ``data:`` lines that a blank line ends.

``lines`` has ``session, pos, raw``; frames are numbered by the blank lines before them, a
sum in buckets, so a feed of any length is many tasks.  A frame that no blank line ends
isn't complete and gives nothing; a last line of JSON is complete without a line end.
Frames of more than ``LONGEST`` bytes are told but not put together.

Defined results: a null session is a session, a null line is blank; other fields than
``data:`` and comments are skipped; one blank after ``data:`` and a carriage return at
the end go; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.ordered import BUCKET, meet, running_sum
from loglattice.sources.growing import line_state

#: Bytes of the longest event.
LONGEST = 1 << 20


def _judged(frames: DataFrame) -> DataFrame:
    """``session, pos, raw, state``: ``ok``, ``malformed``, ``non_object`` or ``too_long`` (without its text)."""
    state = F.when(F.col("size") > LONGEST, "too_long").otherwise(F.coalesce(line_state(F.col("raw")), F.lit("malformed")))
    return frames.select("session", "pos", F.when(F.col("size") <= LONGEST, F.col("raw")).alias("raw"), state.alias("state"))


def json_lines(lines: DataFrame) -> DataFrame:
    """Every line that isn't blank, as an event."""
    rows = lines.withColumn("raw", F.regexp_replace("raw", "\r$", "")).filter(F.trim("raw") != "")
    return _judged(rows.select("session", "pos", "raw", F.octet_length("raw").alias("size")))


def frames(lines: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Complete frames, at the place of the blank line that ends each; a frame without data is none."""
    raw = F.regexp_replace(F.coalesce("raw", F.lit("")), "\r$", "")
    rows = lines.select("session", F.col("pos").cast("long").alias("pos"), raw.alias("raw"))
    blank = F.when(F.col("raw") == "", 1).otherwise(0)
    rows = running_sum(rows, ["session"], "pos", blank, "ended", bucket).withColumn("frame", F.col("ended") - blank)
    data = F.when(F.startswith("raw", F.lit("data:")), F.regexp_replace(F.substring("raw", 6, 1 << 30), "^ ", ""))
    rows = rows.select("session", "pos", "frame", (blank == 1).alias("ends"), data.alias("data"))
    sums = rows.groupBy("session", "frame").agg(F.max(F.when(F.col("ends"), F.col("pos"))).alias("end"), F.sum(F.octet_length("data")).alias("bytes"), F.count("data").alias("n"))
    sums = sums.filter("end is not null and n > 0").select("session", "frame", F.col("end"), (F.col("bytes") + F.col("n") - 1).alias("size"))
    short = meet(rows.filter("data is not null"), sums.filter(F.col("size") <= LONGEST), ["session", "frame"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "data"))), lambda x: x["data"]), "\n")
    joined = short.groupBy("session", "frame").agg(text.alias("raw"))
    return _judged(meet(sums, joined, ["session", "frame"], "left").select("session", F.col("end").alias("pos"), "raw", "size"))
