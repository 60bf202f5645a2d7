"""Session counters that overlap, agree or contradict, and what they say beside a session's own records.

A rollup is a counter over a whole session, ``session, pos, model, provider, counter_kind,
counter_name``, metrics, ``cost, currency, cost_basis``.  Rollups of equal model, provider
and counter are one partition.  Several rollups of one partition have to agree;
cumulative counters of different partitions are disjoint parts and add up, metric by
metric, where every part has the metric, and cost only within one currency and basis;
anything else has no safe arithmetic and is a conflict.

Everything is an aggregation in two levels (partition, session), so partial sums are
all that is shuffled.  Null sessions, models and providers are values of their own; of
rollups that agree the first by ``pos`` stands; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators.ordered import meet

METRICS = ("input_total", "output_total", "reasoning", "total_tokens")
_COST = ("cost", "currency", "cost_basis")
_PARTITION = ("model", "provider", "counter_kind", "counter_name")


def combine(rollups: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row for each session: ``verdict`` (single, agree, combined, conflict), the metrics, cost, ``gaps`` and ``n_rollups``."""
    values = F.struct(*metrics, *_COST)
    told = F.to_json(values, {"ignoreNullFields": "false"})
    parts = rollups.groupBy("session", *_PARTITION).agg(F.count(F.lit(1)).alias("n"), (F.min(told) == F.max(told)).alias("agrees"), F.min_by(values, "pos").alias("first"), F.min("pos").alias("pos"))
    every = F.count(F.lit(1))
    total = lambda m: F.when(F.count(f"first.{m}") == every, F.sum(f"first.{m}"))
    one_kind = (F.count_distinct(F.coalesce("first.currency", F.lit("")), F.col("first.currency").isNull()) == 1) & (F.count_distinct(F.coalesce("first.cost_basis", F.lit("")), F.col("first.cost_basis").isNull()) == 1)
    sessions = parts.groupBy("session").agg(
        every.alias("n_parts"), F.sum("n").alias("n_rollups"), F.bool_and("agrees").alias("agree"), F.bool_and(F.coalesce(F.col("counter_kind") == "cumulative", F.lit(False))).alias("additive"),
        F.min_by("first", "pos").alias("only"), F.struct(*[total(m).alias(m) for m in metrics], F.when(one_kind, total("cost")).alias("cost"), F.when(one_kind, F.min("first.currency")).alias("currency"), F.when(one_kind, F.min("first.cost_basis")).alias("cost_basis")).alias("sums"),
        F.array(*[F.when((F.count(f"first.{m}") > 0) & total(m).isNull(), F.lit(f"rollup.{m}")) for m in metrics], F.when((F.count("first.cost") > 0) & (~one_kind | total("cost").isNull()), F.lit("rollup.cost"))).alias("missing"),
    )
    conflict = ~F.col("agree") | ((F.col("n_parts") > 1) & ~F.col("additive"))
    verdict = F.when(conflict, "conflict").when(F.col("n_parts") > 1, "combined").when(F.col("n_rollups") > 1, "agree").otherwise("single")
    rows = sessions.withColumn("verdict", verdict)
    shown = lambda m: F.when(F.col("verdict") == "combined", F.col(f"sums.{m}")).when(F.col("verdict") != "conflict", F.col(f"only.{m}"))
    whole_cost = (F.col("verdict") != "combined") | F.col("sums.cost").isNotNull()
    cost = [shown("cost").alias("cost"), F.when(whole_cost, shown("currency")).alias("currency"), F.when(whole_cost, shown("cost_basis")).when(F.col("verdict") == "combined", "unknown").alias("cost_basis")]
    gaps = F.when(F.col("verdict") == "combined", F.array_join(F.array_sort(F.array_compact("missing")), ",")).otherwise("")
    return rows.select("session", "n_rollups", "verdict", *[shown(m).alias(m) for m in metrics], *cost, gaps.alias("gaps"))


def _long(rows: DataFrame, keep: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """A row for each metric."""
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics])))


def coverage(records: DataFrame, rollups: DataFrame, metrics: tuple[str, ...] = METRICS, supported: Column | None = None) -> DataFrame:
    """``session, metric`` with the known, detail and interval totals, the rollup's, what no turn explains, and the ``coverage``.

    ``records(session, turn_id, kind, ...)`` are details, or intervals that hold a turn's whole
    (kind ``interval``; with ``unresolved`` the turn says nothing); ``rollups`` are those of
    :func:`combine`.  ``supported`` is a condition on the session.  A turn whose details exceed
    its interval is left out and makes the metric conflicted.
    """
    interval = F.col("kind") == "interval"
    long = _long(records, ["session", "turn_id", "kind", "unresolved"], metrics)
    turns = long.groupBy("session", "metric", "turn_id").agg(
        F.sum(F.when(~interval, F.col("value"))).alias("detail"), F.max(F.when(interval, F.col("value"))).alias("interval"), F.bool_or(interval & F.coalesce("unresolved", F.lit(False))).alias("unresolved"),
    )
    turns = turns.filter("not coalesce(unresolved, false)").withColumn("over", F.coalesce(F.col("detail") > F.col("interval"), F.lit(False)))
    sums = turns.groupBy("session", "metric").agg(
        F.sum(F.when(~F.col("over"), F.col("detail"))).alias("detail_total"), F.sum(F.when(~F.col("over"), F.col("interval") - F.coalesce("detail", F.lit(0)))).alias("interval_total"), F.bool_or("over").alias("over"),
    )
    tops = _long(rollups.withColumn("clash", F.col("verdict") == "conflict"), ["session", "clash"], metrics).withColumnRenamed("value", "complete")
    every = sums.select("session", "metric").unionByName(tops.select("session", "metric")).distinct()
    both = meet(meet(every, sums, ["session", "metric"], "left"), tops, ["session", "metric"], "left")
    known = F.when(F.coalesce("detail_total", "interval_total").isNotNull(), F.coalesce("detail_total", F.lit(0)) + F.coalesce("interval_total", F.lit(0)))
    both = both.withColumns({"known_total": known, "over": F.coalesce("over", F.lit(False)), "clash": F.coalesce("clash", F.lit(False))}).withColumn("left", F.col("complete") - F.col("known_total"))
    verdict = (
        F.when(~(supported if supported is not None else F.lit(True)), "unsupported").when(F.col("over") | F.col("clash") | (F.col("left") < 0), "conflicted")
        .when(F.coalesce("complete", "known_total").isNotNull(), "partial").otherwise("unknown")
    )
    complete = F.when(F.coalesce(F.col("left") >= 0, F.lit(True)) & ~F.col("clash"), F.col("complete"))
    return both.select("session", "metric", "known_total", "detail_total", "interval_total", complete.alias("complete_total"), F.when(~F.col("over") & ~F.col("clash") & (F.col("left") >= 0), F.col("left")).alias("unattributed"), verdict.alias("coverage"))


def overall(rows: DataFrame, rollups: DataFrame, sessions: DataFrame, supported: Column | None = None, total: str = "total_tokens") -> DataFrame:
    """``session, coverage`` of the whole: one verdict over all metrics; ``sessions`` without any record are not_recorded."""
    each = rows.groupBy("session").agg(F.bool_or(F.col("coverage") == "conflicted").alias("clash"), F.max(F.when((F.col("metric") == total) & F.col("complete_total").isNotNull(), F.col("unattributed"))).alias("left"), F.lit(True).alias("seen"))
    clean = rollups.select("session", (F.col("gaps") == "").alias("clean"))
    joined = meet(meet(sessions.select("session").distinct(), each, ["session"], "left"), clean, ["session"], "left")
    verdict = F.when(~(supported if supported is not None else F.lit(True)), "unsupported").when(F.col("seen").isNull(), "not_recorded").when(F.col("clash"), "conflicted").when(F.col("clean") & (F.col("left") == 0), "complete").otherwise("partial")
    return joined.select("session", verdict.alias("coverage"))
