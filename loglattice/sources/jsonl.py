"""Session files of JSON lines as rows with their line numbers.

Lines are kept as text: reading JSON with an inferred schema would unify types
over rows and lose the difference of 5, "5" and true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.sources.growing import line_state


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, generation, pos, raw, state`` of every finished line below ``path``.

    ``pos`` is the physical line number from 1 (blank and malformed lines count).
    A last line without a line end is held back.  ``state`` is ``ok``,
    ``malformed`` or ``non_object``.  ``generation`` changes when a file is
    replaced or grows.  One file is one row until its lines are exploded; a file
    is one session, the largest known ones have some hundred megabytes.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))
    token = F.sha2(F.concat_ws(":", "path", "size", F.unix_micros("changed")), 256)
    lines = F.split("value", "\n", -1)
    finished = F.slice(lines, F.lit(1), F.size(lines) - 1)
    rows = files.select("path", token.alias("generation"), F.posexplode(finished).alias("k", "raw"))
    return rows.filter(F.trim("raw") != "").select("path", "generation", (F.col("k") + 1).cast("long").alias("pos"), F.regexp_replace("raw", "\r$", "").alias("raw"), line_state(F.col("raw")).alias("state"))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """``source_path, id, mtime, size`` of the session files below ``path``; the id is the UUID in the name, else the name.

    Files without a byte are no sessions and aren't listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path).select("path", "length", "modificationTime")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    uuid = F.regexp_extract(name, "([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1)
    return files.select(F.col("path").alias("source_path"), F.coalesce(F.nullif(uuid, F.lit("")), name).alias("id"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"))


def last_generation(rows: DataFrame) -> DataFrame:
    """Rows of the newest file of each session (``session, mtime``), by the greatest time."""
    newest = rows.groupBy("session").agg(F.max("mtime").alias("mtime"))
    return rows.join(newest, ["session", "mtime"], "left_semi")
