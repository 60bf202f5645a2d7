"""Session lists, search, references and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.text import excerpt, first_line, match_score, snippet


def recent(sessions: DataFrame, top: int | None = None, depth: int | None = None) -> DataFrame:
    """Latest first, missing times last, ties by source and id.

    ``depth`` limits each source before anything else and ``top`` the whole
    list; both are features of the list.
    """
    time = F.coalesce("mtime", F.lit(0))
    if depth is not None:
        rank = F.row_number().over(Window.partitionBy("source").orderBy(time.desc(), "id"))
        sessions = sessions.withColumn("_r", rank).filter(F.col("_r") <= depth).drop("_r")
    ordered = sessions.orderBy(time.desc(), "source", "id")
    return ordered if top is None else ordered.limit(max(0, top))


def list_facts(events: DataFrame) -> DataFrame:
    """First and last user text, last agent text, title and counts of every session, in one aggregation."""
    user, agent = F.col("type") == "user_message", F.col("type") == "assistant_message"
    pick = lambda by, when: by("text", F.when(when, F.col("seq")))
    facts = events.groupBy("session").agg(
        pick(F.min_by, user).alias("first_user_msg"), pick(F.max_by, user).alias("last_user_msg"), pick(F.max_by, agent).alias("last_agent_msg"),
        F.count_if(user).alias("n_user"), F.count_if(agent).alias("n_agent"), F.sum(F.octet_length("text")).alias("n_bytes"),
    )
    title = F.coalesce(F.nullif(F.trim(first_line(F.col("first_user_msg"))), F.lit("")), F.substring("first_user_msg", 1, 60), F.col("session").cast("string"))
    return facts.withColumn("title", excerpt(title))


def search_quick(facts: DataFrame, keywords: list[str]) -> DataFrame:
    """Sessions whose joined fields hold all keywords, with the weighted score; a word across two fields matches with score 0."""
    fields = {name: F.col(name) for name in ("title", "first_user_msg", "last_user_msg", "last_agent_msg")}
    joined = F.lower(F.concat_ws("\n", *fields.values()))
    every = F.lit(True)
    for word in keywords:
        every = every & F.contains(joined, F.lit(word.lower()))
    return facts.filter(every).withColumn("score", match_score(fields, keywords))


def search_deep(messages: DataFrame, keywords: list[str]) -> DataFrame:
    """Sessions whose messages hold all keywords between them, and the surroundings of the first hit.

    The first message with any keyword decides, and in it the first keyword of
    the list; only flags and one snippet for each session are shuffled.
    """
    hits = [F.contains(F.lower("text"), F.lit(w.lower())) for w in keywords]
    shown = F.coalesce(*[snippet(F.col("text"), w) for w in keywords])
    some = messages.filter(sum((h.cast("int") for h in hits), F.lit(0)) > 0).select("session", "seq", shown.alias("snippet"), *[h.alias(f"_h{k}") for k, h in enumerate(hits)])
    found = some.groupBy("session").agg(F.min_by("snippet", "seq").alias("snippet"), F.min("seq").alias("hit_seq"), *[F.bool_or(f"_h{k}").alias(f"_h{k}") for k in range(len(hits))])
    every = F.lit(True)
    for k in range(len(hits)):
        every = every & F.col(f"_h{k}")
    return found.filter(every).select("session", "hit_seq", "snippet")


def resolve(sessions: DataFrame, ref: str, short: int = 8) -> DataFrame:
    """The sessions a reference may mean: equal ids, else ids that begin with it, else equal short ids."""
    rank = F.when(F.col("id") == ref, 0).when(F.col("id").startswith(ref), 1).when(F.substring("id", 1, short) == ref, 2)
    ranked = sessions.withColumn("_k", rank).filter("_k IS NOT NULL")
    return ranked.join(ranked.agg(F.min("_k").alias("_k")), "_k").drop("_k")


def page(df: DataFrame, order: list[str | Column], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of a total order, and where the next page starts."""
    rows = df.orderBy(*order).offset(offset).limit(size)
    return rows.withColumn("next_offset", F.lit(offset + size))
