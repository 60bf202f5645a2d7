"""Rollups of a session: alone, in agreement, as parts, in conflict; and coverage beside them."""

from pyspark.sql import functions as F

from loglattice.operators import rollups

SCHEMA = "session string, pos long, model string, provider string, counter_kind string, counter_name string, a long, b long, cost double, currency string, cost_basis string"
M = ("a", "b")


def test_combine(spark):
    cum = lambda s, pos, model, a, b, cost=None, cur="USD", kind="cumulative": (s, pos, model, "p", kind, "n", a, b, cost, cur, "native")
    rows = [
        cum("single", 1, "m", 1, None, 0.5), cum("agree", 2, "m", 1, 2), cum("agree", 1, "m", 1, 2), cum("differ", 1, "m", 1, 2), cum("differ", 2, "m", 1, None),
        cum("parts", 1, "x", 1, 5, 0.5), cum("parts", 2, "y", 10, None, 0.25), cum("parts", 3, None, 100, 7, 0.25), cum("parts", 4, "x", 1, 5, 0.5),
        cum("currencies", 1, "x", 1, 1, 0.5), cum("currencies", 2, "y", 1, 1, 0.5, "EUR"), cum("absolute", 1, "x", 1, 1), cum("absolute", 2, "y", 1, 1, kind="absolute"),
        cum("part differs", 1, "x", 1, 1), cum("part differs", 2, "y", 1, 1), cum("part differs", 3, "y", 2, 1), cum(None, 1, "x", 3, 3),
    ]
    got = {r[0]: tuple(r[1:]) for r in rollups.combine(spark.createDataFrame(rows, SCHEMA).repartition(3), M).collect()}
    assert got == {
        "single": (1, "single", 1, None, 0.5, "USD", "native", ""), "agree": (2, "agree", 1, 2, None, "USD", "native", ""), "differ": (2, "conflict", None, None, None, None, None, ""),
        "parts": (4, "combined", 111, None, 1.0, "USD", "native", "rollup.b"), "currencies": (2, "combined", 2, 2, None, None, "unknown", "rollup.cost"), "absolute": (2, "conflict", None, None, None, None, None, ""),
        "part differs": (3, "conflict", None, None, None, None, None, ""), None: (1, "single", 3, 3, None, "USD", "native", ""),
    }
    assert rollups.combine(spark.createDataFrame([], SCHEMA), M).count() == 0


def test_coverage(spark):
    records = spark.createDataFrame([
        ("detail", "t", "detail", False, 5), ("detail", "u", "detail", False, 6), ("residual", "t", "detail", False, 5), ("residual", "t", "interval", False, 9), ("over", "t", "detail", False, 5), ("over", "t", "interval", False, 4), ("over", "u", "detail", False, 1),
        ("unresolved", "t", "interval", True, 5), ("unresolved", "t", "detail", False, 5), ("unresolved", None, "detail", False, 2), ("missing", "t", "detail", False, None), ("whole", "t", "interval", False, 10), ("short", "t", "detail", False, 10), ("clash", "t", "detail", False, 1), ("odd", "t", "detail", False, 1),
    ], "session string, turn_id string, kind string, unresolved boolean, a long")
    tops = spark.createDataFrame([("residual", "single", 12, ""), ("whole", "single", 10, ""), ("short", "single", 9, ""), ("clash", "conflict", None, ""), ("top only", "single", 3, ""), ("gappy", "combined", None, "rollup.b")], "session string, verdict string, a long, gaps string")
    supported = F.col("session") != "odd"
    rows = rollups.coverage(records, tops, ("a",), supported)
    got = {r[0]: tuple(r[2:]) for r in rows.collect()}
    assert got == {
        "detail": (11, 11, None, None, None, "partial"), "residual": (9, 5, 4, 12, 3, "partial"), "over": (1, 1, None, None, None, "conflicted"), "unresolved": (2, 2, None, None, None, "partial"), "missing": (None, None, None, None, None, "unknown"),
        "whole": (10, None, 10, 10, 0, "partial"), "short": (10, 10, None, None, None, "conflicted"), "clash": (1, 1, None, None, None, "conflicted"), "top only": (None, None, None, 3, None, "partial"), "odd": (1, 1, None, None, None, "unsupported"), "gappy": (None, None, None, None, None, "unknown"),
    }
    sessions = spark.createDataFrame([(s,) for s in [*got, "nothing"]], "session string")
    total = {r[0]: r[1] for r in rollups.overall(rows, tops, sessions, supported, "a").collect()}
    assert total == {k: "conflicted" if v[-1] == "conflicted" else "unsupported" if k == "odd" else "complete" if k == "whole" else "partial" for k, v in got.items()} | {"nothing": "not_recorded"}
