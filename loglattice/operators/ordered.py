"""Order-sensitive derivations that stay parallel within one large key.

A window over a whole session is one task however long the session is.  These
operators cut the order into buckets, work within each bucket in parallel, and
only carry one row for each bucket across (two-level scans).

Defined results: a null key is a key of its own; rows tied in ``seq`` come in any
order among themselves; an empty table gives no row.  Columns whose names begin
with an underscore are for these operators, the input should have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one session that one task walks through.
BUCKET = 1 << 16


def _before(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def bound(df: DataFrame) -> DataFrame:
    """``df`` behind a generator, so that what its columns cost is paid once, however often they are named above."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined by ``keys``; null meets null."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_key_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_key_{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], seq: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, by ``seq`` within ``keys``."""
    cut = df.withColumn("_b", F.floor(F.col(seq) / bucket)).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(_before(keys, "_b")), F.lit(0))).drop("_t")
    return meet(cut.withColumn(name, F.sum("_v").over(local)), totals, [*keys, "_b"]).withColumn(name, F.col(name) + F.col("_base")).drop("_b", "_v", "_base")


def carry_forward(df: DataFrame, keys: list[str], seq: str, value: Column, name: str, bucket: int = BUCKET, strict: bool = False) -> DataFrame:
    """``df`` with the latest non-null ``value`` at or before (``strict``: before) each row (as-of within the log)."""
    cut = df.withColumn("_b", F.floor(F.col(seq) / bucket)).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    lasts = cut.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(seq))).alias("_l"))
    lasts = lasts.withColumn("_base", F.last("_l", ignorenulls=True).over(_before(keys, "_b"))).drop("_l")
    held = meet(cut.withColumn(name, F.last("_v", ignorenulls=True).over(local)), lasts, [*keys, "_b"])
    return held.withColumn(name, F.coalesce(name, "_base")).drop("_b", "_v", "_base")


def _merge(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Joins intervals ``(lo, hi)`` whose distance is at most ``gap``; ``n`` is summed."""
    reach = F.max("hi").over(_before(keys, "lo", "hi"))
    marked = df.withColumn("_new", F.when(F.col("lo") - reach <= gap, 0).otherwise(1))
    part = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_k", F.sum("_new").over(part))
    return marked.groupBy(*keys, "_k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("_k")


def islands(df: DataFrame, keys: list[str], gap: int, bucket: int) -> DataFrame:
    """``keys, lo, hi, n``: maximal runs of the intervals ``lo, hi`` whose neighbours are at most ``gap`` apart (inclusive).

    Equal intervals are counted before the shuffle.  Each bucket of width
    ``bucket`` is merged on its own.  Of a bucket one row goes on: how far it
    reaches, and where its last island begins.  From these every bucket learns how
    far all before it reach, and the beginning of the last run before it (a
    bucket's last island begins a run of the whole unless those before it reach
    that far).  A run is known by its beginning, which its later islands take over.
    """
    counted = df.groupBy(*keys, "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    local = _merge(counted.withColumn("_b", F.floor(F.col("lo") / bucket)), [*keys, "_b"], gap)
    ends = local.groupBy(*keys, "_b").agg(F.max("hi").alias("_end"), F.max("lo").alias("_last"))
    ends = ends.withColumn("_reach", F.max("_end").over(_before(keys, "_b")))
    opened = F.when(F.coalesce(F.col("_last") - F.col("_reach") > gap, F.lit(True)), F.col("_last"))
    ends = ends.withColumn("_run", F.max(opened).over(_before(keys, "_b"))).drop("_end", "_last")
    begun = meet(local, ends, [*keys, "_b"])
    starts = F.when(F.coalesce(F.col("lo") - F.col("_reach") > gap, F.lit(True)), F.col("lo"))
    upto = Window.partitionBy(*keys, "_b").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    known = begun.withColumn("_k", F.coalesce(F.max(starts).over(upto), "_run"))
    return known.groupBy(*keys, "_k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("_k")


def with_repeats(df: DataFrame, keys: list[str], seq: str, values: list[str], name: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with whether a row equals the row before it in ``values`` (null equals null)."""
    cut = df.withColumns({"_b": F.floor(F.col(seq) / bucket), "_v": F.struct(*values)})
    lasts = cut.groupBy(*keys, "_b").agg(F.max_by("_v", seq).alias("_l"))
    lasts = lasts.withColumn("_last", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_l")
    near = Window.partitionBy(*keys, "_b").orderBy(seq)
    held = meet(cut.withColumns({"_near": F.lag("_v").over(near), "_at": F.row_number().over(near)}), lasts, [*keys, "_b"])
    same = F.when(F.col("_at") == 1, F.col("_last")).otherwise(F.col("_near")).eqNullSafe(F.col("_v"))
    return held.withColumn(name, same).drop("_b", "_v", "_near", "_at", "_last")


def drop_repeats(df: DataFrame, keys: list[str], seq: str, values: list[str], bucket: int = BUCKET) -> DataFrame:
    """Rows that differ in ``values`` from the row before them (consecutive dedup)."""
    return with_repeats(df, keys, seq, values, "_same", bucket).filter("not _same").drop("_same")


def numbered_within(df: DataFrame, keys: list[str], pos: str, sub: str, name: str) -> DataFrame:
    """``df`` with a dense number from 1 by ``pos`` and, within it, ``sub``, however many rows share a ``pos``.

    How many rows come before a ``pos`` is a row of its own, ahead of those it counts for, so ``df`` crosses one shuffle and no join.
    """
    counts = df.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("_c"))
    before = running_sum(counts, keys, pos, F.col("_c"), "_u").select(*keys, pos, (F.col("_u") - F.col("_c")).alias("_n"), F.lit(False).alias("_row"))
    rows = df.withColumns({"_n": F.lit(1).cast("long"), "_row": F.lit(True)}).unionByName(before, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, pos).orderBy("_row", sub).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum("_n").over(upto)).filter("_row").drop("_n", "_row")
