"""Active time: gap sessions, clipping, unions, concurrency and histograms.

All times are whole microseconds, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.ordered import islands, meet
from loglattice.sources.shared import settle

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
GAP, TAIL = 300 * SECOND, 60 * SECOND


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def active_intervals(stamps: DataFrame, keys: list[str], gap: int = GAP, tail: int = TAIL) -> DataFrame:
    """``keys, a, b, n``: stamps ``t`` at most ``gap`` apart form an interval that lasts ``tail`` beyond its last stamp.

    The gap is measured between stamps, not from the extended end; null stamps are no activity.
    """
    points = stamps.filter("t IS NOT NULL").select(*keys, F.col("t").alias("lo"), F.col("t").alias("hi"))
    return islands(points, keys, gap, max(DAY, 4 * gap)).select(*keys, F.col("lo").alias("a"), (F.col("hi") + tail).alias("b"), "n")


def clip(intervals: DataFrame, since: int, until: int) -> DataFrame:
    """The parts of the intervals in ``[since, until)``; intervals that only touch it vanish."""
    cut = intervals.withColumns({"a": F.greatest("a", F.lit(since)), "b": F.least("b", F.lit(until))})
    return cut.filter("b > a")


def seconds(amount: Column) -> Column:
    return amount / F.lit(float(SECOND))


def ledger(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each session: activity and interval counts, active seconds, first and last moment."""
    sums = intervals.groupBy(*keys).agg(F.sum("n").alias("activity_count"), F.count(F.lit(1)).alias("interval_count"), F.sum(F.col("b") - F.col("a")).alias("_d"), F.min("a").alias("first_us"), F.max("b").alias("last_us"))
    return sums.withColumn("active_seconds", seconds(F.col("_d"))).drop("_d")


def union_length(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, union_seconds``: time covered by at least one interval; touching intervals merge."""
    spans = intervals.filter("b > a").select(*keys, F.col("a").alias("lo"), F.col("b").alias("hi"))
    merged = islands(spans, keys, 0, DAY)
    return merged.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("_d")).select(*keys, seconds(F.col("_d")).alias("union_seconds"))


def overlap(one: DataFrame, two: DataFrame, keys: list[str], bucket: int = HOUR) -> DataFrame:
    """``keys, both_seconds, one_seconds, two_seconds``: time covered by both sets of intervals, and by one of them only.

    So a response's own time is what tools don't cover.  Each set may overlap itself.
    Changes are summed by moment before the shuffle; buckets of time are swept in
    parallel, and one row of each tells the next how many intervals are open and the
    last when it ends.  Intervals that aren't positive cover nothing; a null key is a key.
    """
    def steps(intervals: DataFrame, first: bool) -> DataFrame:
        change = F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("d")))).alias("x")
        return intervals.filter("b > a").select(*keys, change).select(*keys, "x.t", *[(F.col("x.d") if mine == first else F.lit(0)).alias(c) for c, mine in (("p", True), ("q", False))])

    moments = steps(one, True).unionByName(steps(two, False)).groupBy(*keys, "t").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).withColumn("_b", F.floor(F.col("t") / bucket))
    inner = Window.partitionBy(*keys, "_b").orderBy("t")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    swept = moments.withColumns({"_p": F.sum("p").over(upto), "_q": F.sum("q").over(upto), "_next": F.lead("t").over(inner)})
    parts = moments.groupBy(*keys, "_b").agg(F.sum("p").alias("_bp"), F.sum("q").alias("_bq"), F.min("t").alias("_first"))
    outer = Window.partitionBy(*keys).orderBy("_b")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_b", F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_bq").over(before), F.lit(0)).alias("_q0"), F.lead("_first").over(outer).alias("_then"))
    lengths = meet(swept, parts, [*keys, "_b"]).select(*keys, (F.col("_p") + F.col("_p0") > 0).alias("p"), (F.col("_q") + F.col("_q0") > 0).alias("q"), (F.coalesce("_next", "_then") - F.col("t")).alias("d"))
    of = lambda p, q: seconds(F.coalesce(F.sum(F.when((F.col("p") == p) & (F.col("q") == q), F.col("d"))), F.lit(0)))
    return lengths.groupBy(*keys).agg(of(True, True).alias("both_seconds"), of(True, False).alias("one_seconds"), of(False, True).alias("two_seconds"))


def peak_concurrency(intervals: DataFrame, keys: list[str], bucket: int = HOUR) -> DataFrame:
    """``keys, peak, peak_at_us``: most intervals open at once and the first moment of it.

    Ends come before starts at the same moment.  Changes are summed by moment
    before the shuffle; hours are swept in parallel, then their totals.
    """
    change = F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("d")))).alias("x")
    steps = intervals.filter("b > a").select(*keys, change).groupBy(*keys, F.col("x.t").alias("t"), F.col("x.d").alias("d")).agg(F.sum("x.d").alias("s"))
    steps = steps.withColumn("_b", F.floor(F.col("t") / bucket))
    inner = Window.partitionBy(*keys, "_b").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.withColumn("open", F.sum("s").over(inner))
    tops = swept.groupBy(*keys, "_b").agg(F.min_by(F.struct("open", "t"), F.struct(-F.col("open"), "t")).alias("top"), F.sum("s").alias("s"))
    base = F.coalesce(F.sum("s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select(*keys, (base + F.col("top.open")).alias("open"), F.col("top.t").alias("t"))
    best = F.min_by(F.struct("open", "t"), F.struct(-F.col("open"), "t")).alias("top")
    grouped = tops.groupBy(*keys) if keys else tops
    return grouped.agg(best).filter("top IS NOT NULL").select(*keys, F.col("top.open").alias("peak"), F.col("top.t").alias("peak_at_us"))


def weekday_hours(intervals: DataFrame, offset: int = 0) -> DataFrame:
    """``dow, hour, seconds`` for all 168 hours of a week (Monday is 0) at a fixed offset from UTC."""
    shifted = intervals.filter("b > a").select((F.col("a") + offset).alias("a"), (F.col("b") + offset).alias("b"))
    hours = shifted.select("a", "b", F.explode(F.sequence(F.floor(F.col("a") / HOUR), F.floor((F.col("b") - 1) / HOUR))).alias("h"))
    part = F.least(F.col("b"), (F.col("h") + 1) * HOUR) - F.greatest(F.col("a"), F.col("h") * HOUR)
    # 1970-01-01 was a Thursday
    sums = hours.groupBy(F.pmod(F.floor(F.col("h") / 24) + 3, F.lit(7)).cast("int").alias("dow"), F.pmod("h", F.lit(24)).cast("int").alias("hour")).agg(F.sum(part).alias("_d"))
    grid = intervals.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(F.broadcast(sums), ["dow", "hour"], "left").select("dow", "hour", seconds(F.coalesce("_d", F.lit(0))).alias("seconds"))  # at most 168 rows


def project_rollup(intervals: DataFrame, project: str, session: str, runtime: str | None = None) -> DataFrame:
    """One row for each project: sessions, active seconds, union seconds and peak; a null or empty project has a name of its own.

    The intervals are settled, since sums, unions and peaks all read them.
    """
    named = settle(intervals, "intervals").withColumn("project", F.coalesce(F.nullif(F.col(project), F.lit("")), F.lit("__missing_cwd__")))
    by_session = named.groupBy("project", session).agg(F.sum("n").alias("n"), F.sum(F.col("b") - F.col("a")).alias("d"))
    sums = by_session.groupBy("project").agg(F.count(F.lit(1)).alias("session_count"), F.sum("n").alias("activity_count"), F.sum("d").alias("_d"))
    out = sums.join(union_length(named, ["project"]), "project", "left").join(peak_concurrency(named, ["project"]), "project", "left")
    return out.withColumn("active_seconds", seconds(F.col("_d"))).drop("_d")
