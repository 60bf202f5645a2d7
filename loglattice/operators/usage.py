"""Token and cost observations: one identity each, reconciled, then summed without inventing zeros.

An observation has ``session, pos, response_id, turn_id, scope, model,
input_tokens, output_tokens, ...``; ``pos`` orders a session's observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.guards import sum_present


def normalise(obs: DataFrame) -> DataFrame:
    """Inclusive input and total: parts that are there are summed, a total needs both sides."""
    whole = sum_present(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"))
    return obs.withColumn("input_total", whole).withColumn("total_tokens", F.col("input_total") + F.col("output_tokens"))


def record_key() -> Column:
    """The identity of an observation: response, else turn counter, else session counter with its model, else the record itself."""
    named = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (
        F.when(F.col("response_id").isNotNull(), named("response", F.col("response_id")))
        .when((F.col("scope") == "turn") & F.col("turn_id").isNotNull(), named("turn", F.col("turn_id")))
        .when(F.col("scope") == "session", named("session", F.col("model")))
        .otherwise(named("record", F.col("pos")))
    )


def reconcile(obs: DataFrame, metrics: list[str]) -> DataFrame:
    """One record for each identity with ``confidence``.

    Equal members collapse (missing equals missing).  Counters of a turn or
    session take their latest values and keep the turn and model of their first
    member.  Other members that differ are in conflict: metrics become null.
    """
    keyed = obs.withColumn("record_key", record_key()).withColumn("_m", F.struct(*metrics)).withColumn("_s", F.to_json("_m", {"ignoreNullFields": "false"}))
    grouped = keyed.groupBy("session", "record_key").agg(
        F.count(F.lit(1)).alias("n_members"), (F.min("_s") == F.max("_s")).alias("_same"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.max_by("_m", "pos").alias("_last"), F.min_by(F.struct("turn_id", "model", "scope"), "pos").alias("_first"),
    )
    counter = F.col("record_key").rlike(r"^(turn|session)\|")
    confidence = F.when(F.col("n_members") == 1, "single").when(F.col("_same"), "equal").when(counter, "latest").otherwise("conflicted")
    values = [F.when(F.col("confidence") != "conflicted", F.col(f"_last.{m}")).alias(m) for m in metrics]
    return grouped.withColumn("confidence", confidence).select("session", "record_key", "confidence", "n_members", "first_pos", "last_pos", "_first.turn_id", "_first.model", "_first.scope", *values)


def turn_residuals(details: DataFrame, intervals: DataFrame) -> DataFrame:
    """Details of a turn against the turn's own total.

    ``details(session, turn_id, amount)``, ``intervals(session, turn_id, amount)``.
    What a turn's total has beyond its details is the residual; a total below
    its details is a conflict and the turn counts nothing.
    """
    parts = details.groupBy("session", "turn_id").agg(F.sum("amount").alias("detail"), F.count(F.lit(1)).alias("n_details"))
    wholes = intervals.groupBy("session", "turn_id").agg(F.max("amount").alias("interval"))
    both = parts.join(wholes, ["session", "turn_id"], "full_outer")
    conflict = F.coalesce(F.col("detail") > F.col("interval"), F.lit(False))
    known = F.when(~conflict, F.coalesce("interval", "detail"))
    return both.select("session", "turn_id", "n_details", "detail", "interval", conflict.alias("conflicted"), F.when(~conflict, F.col("interval") - F.coalesce("detail", F.lit(0))).alias("residual"), known.alias("known"))


def session_totals(turn_rows: DataFrame, rollups: DataFrame) -> DataFrame:
    """Known total, the session's own rollup, what no turn explains, and the coverage verdict.

    Sums are null where nothing is known; a rollup never enters the known total.
    """
    sums = turn_rows.groupBy("session").agg(F.sum("detail").alias("detail_total"), F.sum("residual").alias("residual_total"), F.sum("known").alias("known_total"), F.count_if("conflicted").alias("n_conflicts"), F.count_if(F.col("interval").isNull()).alias("n_gaps"))
    tops = rollups.groupBy("session").agg(F.min("amount").alias("_low"), F.max("amount").alias("complete_total"))
    both = sums.join(tops, "session", "full_outer").withColumn("complete_total", F.when(F.col("_low") == F.col("complete_total"), F.col("complete_total")))
    left = F.col("complete_total") - F.coalesce("known_total", F.lit(0))
    verdict = (
        F.when(F.col("known_total").isNull() & F.col("complete_total").isNull(), "not_recorded")
        .when((F.col("n_conflicts") > 0) | (left < 0), "conflicted")
        .when(F.col("complete_total").isNull() | (F.col("n_gaps") > 0) | (left != 0), "partial")
        .otherwise("complete")
    )
    return both.select("session", "detail_total", "residual_total", "known_total", "complete_total", F.when(left >= 0, left).alias("unattributed"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), verdict.alias("coverage"), F.coalesce("complete_total", "known_total").alias("reported_total"))


def cost_groups(rows: DataFrame) -> DataFrame:
    """Costs by currency and basis; they are never added across."""
    return rows.groupBy("currency", "basis").agg(F.sum("cost").alias("cost"), F.count("cost").alias("n_costs"), F.count_if(F.col("cost").isNull()).alias("n_missing"))


def model_slices(rows: DataFrame, cap: int = 50) -> DataFrame:
    """Tokens by model, the missing model included, in the order of their names; ``omitted`` tells how many come after the first ``cap`` (a report)."""
    sums = rows.groupBy("model").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_rows"))
    named = sums.withColumn("_k", F.coalesce(F.col("model").cast("string"), F.lit("None")))
    total = sums.agg(F.count(F.lit(1)).alias("_n"))
    top = named.orderBy("_k").limit(cap)
    return top.crossJoin(F.broadcast(total)).select("model", "amount", "n_rows", F.greatest(F.col("_n") - cap, F.lit(0)).alias("omitted"))  # one row


def nearest_percentile(df: DataFrame, keys: list[str], value: str, share: float = 0.95, bins: int = 4096) -> DataFrame:
    """The value at place ``floor(share * n)`` (from 0, not interpolated) in ascending order, and the median.

    Null values don't count; a key without values has no row.  Equal values are
    counted first.  Each key's range is cut into ``bins`` equal widths whose
    counts tell which of them hold the places asked for; only those are sorted.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ends = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    placed = counts.join(ends, keys).withColumn("_bin", F.coalesce(F.floor((F.col(value) - F.col("_lo")) / width * bins), F.lit(0)))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*keys, "_bin", "_n").agg(F.sum("_c").alias("_t")).withColumn("_u", F.sum("_t").over(upto))
    last = F.col("_n") - 1
    asked = F.array(*[F.struct(F.lit(name).alias("what"), place.cast("long").alias("at")) for name, place in (("p95", F.least(F.floor(F.col("_n") * share), last)), ("a", F.floor(last / 2)), ("b", F.floor(F.col("_n") / 2)))])
    wanted = sums.select(*keys, "_bin", "_n", "_u", (F.col("_u") - F.col("_t")).alias("_before"), F.explode(asked).alias("q")).filter((F.col("q.at") >= F.col("_before")) & (F.col("q.at") < F.col("_u")))
    inside = placed.select(*keys, "_bin", value, "_c").join(wanted.select(*keys, "_bin", "_before", "_n", "q.what", "q.at"), [*keys, "_bin"])
    run = Window.partitionBy(*keys, "what").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("_v", F.col("_before") + F.sum("_c").over(run)).filter(F.col("_v") > F.col("at"))
    first = found.groupBy(*keys, "what", "_n").agg(F.min(value).alias("_x"))
    one = lambda name: F.max(F.when(F.col("what") == name, F.col("_x")))
    return first.groupBy(*keys).agg(F.max("_n").alias("n"), one("p95").alias("p95"), ((one("a") + one("b")) / 2).alias("median"))
