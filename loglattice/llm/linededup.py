"""Line deduplication by site-relative frequency.

Within each host, a line's frequency is the number of pages that contain it
divided by the host's pages; a line over the boilerplate ratio is dropped from
every page of that host.  Counting explodes each page's *distinct* lines as
64-bit hashes and combines them before the shuffle, so a host with a third of
all pages costs its partial sums only.  The flagged lines of a host are few by
construction (at most the mean number of distinct lines of its pages divided by
the ratio); they are written out, so Spark sees their size and either
broadcasts them or joins by host.

Defined results: lines are compared after trimming ASCII white space; lines
without a character other than that are never counted nor dropped; null text
stays null and keeps its length column; a null host is a host of its own; a host with fewer than
``min_pages`` pages holding a line keeps that line; a page all of whose lines
are dropped has empty text; repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm import storage

SPACE = " \t\n\x0b\f\r"
RATIO = 0.1
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without its port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE)))


def _blank(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE))) == 0


def boilerplate(df: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host_key`` and the hashes of its boilerplate lines."""
    pages = df.select(F.struct(F.col(host).alias("h")).alias("host_key"), F.col(text).alias("t"))
    totals = pages.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), lambda x: ~_blank(x)), _key))
    counts = pages.select("host_key", F.explode(hashes).alias("line")).groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("n"))
    over = counts.filter(F.col("n") >= min_pages).join(totals, "host_key").filter(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    return over.groupBy("host_key").agg(F.collect_list("line").alias("flagged"))


def drop_boilerplate(df: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False, length: str | None = None) -> DataFrame:
    """``df`` with boilerplate lines removed from ``text``.

    With ``counts``, ``n_lines`` and ``n_dropped`` are added; ``length`` names a
    column that is to hold the new text's length.
    """
    flagged = storage.settle(boilerplate(df, host, text, ratio, min_pages), "boilerplate")
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(F.col(host).alias("h")).alias("host_key"))
    joined = rows.join(flagged, "host_key", "left")
    lines = _lines(F.col(f"row.`{text}`"))
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains("flagged", _key(x)))
    joined = joined.withColumn("kept", F.when(F.col("flagged").isNull(), lines).otherwise(kept))
    new = {text: F.array_join("kept", "\n")}
    if length:
        new[length] = F.coalesce(F.length(new[text]).cast(df.schema[length].dataType), F.col(f"row.`{length}`"))
    out = [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names]
    if counts:
        out += [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped")]
    return joined.select(*out)
