"""Checks of an event log and of the views made from it: one row for each violation, ``session, rule, detail``.

Empty tables violate nothing; rows with a null session are checked as one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators.filters import sequence_faults, union_sources
from loglattice.operators.ordered import meet
from loglattice.operators.turns import conversation

STATUSES = ("ok", "error", "denied", "pending", "unknown")


def _fault(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select("session", F.lit(rule).alias("rule"), detail.alias("detail"))


def sequence(events: DataFrame) -> DataFrame:
    """Numbers that aren't 1 to n."""
    return _fault(sequence_faults(events), "seq", F.format_string("%d events, %d numbers", "expected", "found"))


def pairing(events: DataFrame) -> DataFrame:
    """Results whose id no earlier call has."""
    named = events.filter(F.coalesce("call_id", F.lit("")) != "")
    calls = named.filter("type = 'tool_call'").groupBy("session", "call_id").agg(F.min("seq").alias("first"))
    found = meet(named.filter("type = 'tool_result'"), calls, ["session", "call_id"], "left").filter("first IS NULL OR first > seq")
    return _fault(found, "tool_pairing", F.format_string("result %d has no earlier call", "seq"))


def statuses(events: DataFrame, column: str = "result_status") -> DataFrame:
    """Results whose status isn't one of the known ones."""
    return _fault(events.filter((F.col("type") == "tool_result") & ~F.coalesce(F.col(column).isin(*STATUSES), F.lit(False))), "result_status", F.format_string("result %d", "seq"))


def same_rows(made: DataFrame, given: DataFrame, rule: str) -> DataFrame:
    """Rows that are in one table and not, or not as often, in the other."""
    extra, missing = made.exceptAll(given.select(*made.columns)), given.select(*made.columns).exceptAll(made)
    return union_sources(_fault(extra, rule, F.lit("not in the view")), _fault(missing, rule, F.lit("not in the events")))


def conversation_view(events: DataFrame, view: DataFrame) -> DataFrame:
    """Whether a conversation (``session, seq, role, text``) is what the events show, in order and number."""
    return same_rows(conversation(events).select("session", "seq", "role", "text"), view, "conversation")


def all_rules(events: DataFrame, view: DataFrame) -> DataFrame:
    return union_sources(sequence(events), pairing(events), conversation_view(events, view))
