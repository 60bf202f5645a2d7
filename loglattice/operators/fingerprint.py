"""Fingerprints of ordered tables that can be put together, so that appends are told from changes.

A row's number is taken from its columns; long bodies give their length only.  The
fingerprint of a run of rows is a polynomial of these numbers in their order, modulo
two primes, with the power that carries it past what follows:

    (h, p) then (h', p')  is  (h p' + h', p p')

So rows swapped, changed, lost or repeated give another one, and runs of any length
can be put together in any grouping: buckets first, then ``FAN`` buckets at a time, as
:mod:`loglattice.operators.automaton` does.  A store that has grown only by appends has
the old fingerprint up to the old last place, which is found without its bodies.

Defined results: a null key is a key; null columns differ from empty ones; rows tied in
``seq`` are taken in the order of their numbers; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators.ordered import meet

BUCKET, FAN = 1 << 12, 256
#: Primes below 2^31, so that products fit into 64 bits, and the bases of the polynomials.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)


def row_number(columns: list[str], bodies: list[str] | None = None) -> list[Column]:
    """Two numbers of a row, below 2^28: of its columns, and of the lengths of its bodies."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    shown += [F.coalesce(F.length(b).cast("string"), F.lit("-")) for b in bodies or []]
    digest = F.md5(F.concat_ws("\x1f", *shown).cast("binary"))
    return [F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 9)]


def _join(parts: Column, k: int) -> Column:
    """Runs one after another; a run is its hash and its power."""
    prime = F.lit(PRIMES[k]).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("p"))
    return F.aggregate(parts, start, lambda a, x: F.struct(((a["h"] * x["p"] + x["h"]) % prime).alias("h"), ((a["p"] * x["p"]) % prime).alias("p")))


def fingerprint(rows: DataFrame, keys: list[str], seq: str, columns: list[str], bodies: list[str] | None = None, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """``keys, fingerprint, n, last``: of all rows of each key in the order of ``seq``; ``bucket`` is a width of ``seq``."""
    numbers = row_number(columns, bodies)
    held = rows.select(*keys, F.col(seq).cast("long").alias("_seq"), *[x.alias(f"_n{k}") for k, x in enumerate(numbers)])
    totals = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("_seq").alias("last"))
    span = held.agg(F.coalesce(F.min("_seq"), F.lit(0)), F.coalesce(F.max("_seq"), F.lit(0))).first()
    buckets = (span[1] - span[0]) // bucket + 1
    inner = F.sort_array(F.collect_list(F.struct("_seq", "_n0", "_n1")))
    parts = held.groupBy(*keys, F.floor((F.col("_seq") - span[0]) / bucket).alias("_b")).agg(inner.alias("_inner"))
    single = lambda k: F.transform("_inner", lambda x: F.struct(x[f"_n{k}"].alias("h"), F.lit(BASES[k]).cast("long").alias("p")))
    parts = parts.select(*keys, "_b", *[_join(single(k), k).alias(f"_p{k}") for k in (0, 1)])
    part = lambda k: lambda x: x[f"_p{k}"]
    while buckets > 1:
        buckets = -(-buckets // fan)
        together = F.sort_array(F.collect_list(F.struct("_b", "_p0", "_p1")))
        parts = parts.groupBy(*keys, F.floor(F.col("_b") / fan).alias("_b")).agg(together.alias("_runs"))
        parts = parts.select(*keys, "_b", *[_join(F.transform("_runs", part(k)), k).alias(f"_p{k}") for k in (0, 1)])
    shown = F.concat_ws("-", *[F.col(f"_p{k}.h") for k in (0, 1)])
    return meet(parts.select(*keys, shown.alias("fingerprint")), totals, keys)


def changes(old: DataFrame, rows: DataFrame, keys: list[str], seq: str, columns: list[str], bodies: list[str] | None = None) -> DataFrame:
    """``keys, verdict``: ``same``, ``appended``, ``changed``, ``new`` or ``gone``, by the fingerprints of the time before (``old``)."""
    before = old.withColumnsRenamed({"fingerprint": "_old", "n": "_old_n", "last": "_old_last"})
    upto = meet(rows, before.select(*keys, "_old_last"), keys).filter(F.col(seq) <= F.col("_old_last"))
    again = fingerprint(upto, keys, seq, columns, bodies).select(*keys, "fingerprint")
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    every = before.select(*keys).unionByName(totals.select(*keys)).distinct()
    all_ = meet(meet(meet(every, before, keys, "left"), again, keys, "left"), totals, keys, "left")
    same = F.col("_old").eqNullSafe(F.col("fingerprint"))
    verdict = F.when(F.col("_n").isNull(), "gone").when(F.col("_old").isNull(), "new").when(~same, "changed").when(F.col("_n") > F.col("_old_n"), "appended").otherwise("same")
    return all_.select(*keys, verdict.alias("verdict"))
