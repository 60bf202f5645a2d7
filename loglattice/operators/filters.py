"""Filters, exclusions, orders, pages and set operations over session lists and fact tables.

A null in a tested column fails every filter, as it does in the lists; empty
tables give empty results; other columns pass through.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.ordered import meet, running_sum

#: The status tags of a list and what they are called.
STATUS_LABELS = {"✅已完成": "done", "⏳待回复": "pending", "⚠️已中断": "aborted"}


def pick_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named columns that exist, in the order of the table."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in fields])


def status_label(tag: Column) -> Column:
    """``done``, ``pending`` or ``aborted``; anything else, null included, is ``unknown``."""
    table = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, tag), F.lit("unknown"))


def select_sessions(df: DataFrame, status: str | None = None, cwd: str | None = None, cwd_prefix: str | None = None, source: str | None = None, live: bool = False, since: float | None = None, until: float | None = None) -> DataFrame:
    """Sessions of a list: by status label, part of the working folder in any case, its beginning, source, liveness and time (both ends inclusive)."""
    tests = []
    if status is not None:
        tests.append(status_label(F.col("status_tag")) == status)
    if cwd is not None:
        tests.append(F.contains(F.lower(F.coalesce("cwd", F.lit(""))), F.lit(cwd.lower())))
    if cwd_prefix is not None:
        tests.append(F.startswith("cwd", F.lit(cwd_prefix)))
    if source is not None:
        tests.append(F.col("source") == source)
    if live:
        tests.append(F.coalesce(F.col("live"), F.lit(False)))
    if since is not None:
        tests.append(F.col("mtime") >= since)
    if until is not None:
        tests.append(F.col("mtime") <= until)
    for test in tests:
        df = df.filter(test)
    return df


def select_usage(records: DataFrame, turns: list | None = None, messages: list | None = None, models: list | None = None) -> DataFrame:
    """Records of some turns, or else of some messages (by message or response id), and of some models (used or asked for)."""
    if turns:
        records = records.filter(F.col("turn_id").isin(*turns))
    elif messages:
        records = records.filter(F.col("message_id").isin(*messages) | F.coalesce(F.col("response_id").isin(*messages), F.lit(False)))
    if models:
        records = records.filter(F.coalesce(F.col("model").isin(*models), F.lit(False)) | F.coalesce(F.col("requested_model").isin(*models), F.lit(False)))
    return records


def select_performance(records: DataFrame, turn_id: str | None = None, message_id: str | None = None) -> DataFrame:
    """Performance records of one turn, or else of one message (by message or response id); without a choice all.  Records without the id don't match."""
    if turn_id:
        return records.filter(F.col("turn_id") == turn_id)
    if message_id:
        return records.filter(F.coalesce(F.col("message_id") == message_id, F.lit(False)) | F.coalesce(F.col("response_id") == message_id, F.lit(False)))
    return records


def select_skills(uses: DataFrame, trigger: str = "all") -> DataFrame:
    """Uses of skills by their trigger: ``explicit``, ``passive`` (any other) or ``all``; uses without a trigger are passive."""
    if trigger not in ("all", "explicit", "passive"):
        raise ValueError("a trigger is all, explicit or passive")
    explicit = F.coalesce(F.col("trigger") == "explicit", F.lit(False))
    return uses if trigger == "all" else uses.filter(explicit if trigger == "explicit" else ~explicit)


def exclusion(known: Column, marked: Column, cwd: Column, internal: Column, user_text: Column) -> Column:
    """Why a list drops a session; null if it doesn't.

    ``known`` and ``marked`` say whether the working folder exists and whether it
    or one above it holds the ignore mark; they come from a table of folders,
    since executors don't see the host's.
    """
    blank = F.length(F.trim(F.coalesce(user_text, F.lit("")))) == 0
    return (
        F.when(F.coalesce(internal, F.lit(False)), "internal")
        .when((F.coalesce(cwd, F.lit("")) == "") | ~F.coalesce(known, F.lit(False)), "missing_cwd")
        .when(F.coalesce(marked, F.lit(False)), "ephemeral_marker")
        .when(blank, "empty_user")
    )


def with_folders(sessions: DataFrame, folders: DataFrame) -> DataFrame:
    """Sessions with ``known`` and ``marked``, from ``folders(path, marked)``: a mark holds for all folders below it."""
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("cwd", "/"))), lambda k: F.array_join(F.slice(F.split("cwd", "/"), F.lit(1), k), "/"))
    paths = sessions.select("cwd").filter("cwd IS NOT NULL").distinct()
    up = paths.select("cwd", F.explode(above).alias("path")).join(folders.select("path", "marked").distinct(), "path")
    told = up.groupBy("cwd").agg(F.bool_or(F.col("path") == F.col("cwd")).alias("known"), F.bool_or("marked").alias("marked"))
    return sessions.join(told, "cwd", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "marked": F.coalesce("marked", F.lit(False))})


def ranked_hits(facts: DataFrame) -> DataFrame:
    """Search hits: highest score first, then latest; ties by id."""
    return facts.orderBy(F.desc("score"), F.desc(F.coalesce("mtime", F.lit(0))), "id")


def by_activity(ledger: DataFrame) -> DataFrame:
    """Most active sessions first; ties by id."""
    return ledger.orderBy(F.desc("active"), "id")


def union_sources(*lists: DataFrame) -> DataFrame:
    """All sources in one list (a bag); columns that a source lacks are null."""
    out = lists[0]
    for one in lists[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def prefer_first(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both tables, but of ``new`` only what ``old`` doesn't have."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def distinct_ids(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Ids that occur on either side, once each."""
    return one.select(*keys).union(two.select(*keys)).distinct()


def message_models(records: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row for each record: its models, what it is attributed to, and the first event of its message, else of its response."""
    scope = F.when(F.col("scope") == "message", "message").when(F.col("scope").isin("call", "turn"), "turn").otherwise("unknown")
    rows = records.withColumn("attribution", scope)
    if events is None:
        return rows.withColumn("seq", F.lit(None).cast("long"))
    first = events.filter(F.col("message_id") != "").groupBy("session", "message_id").agg(F.min("seq").alias("seq"))
    own = first.select("session", "message_id", F.col("seq").alias("_own"))
    reply = first.select("session", F.col("message_id").alias("response_id"), F.col("seq").alias("_reply"))
    return rows.join(own, ["session", "message_id"], "left").join(reply, ["session", "response_id"], "left").withColumn("seq", F.coalesce("_own", "_reply")).drop("_own", "_reply")


def bare_id(native: Column) -> Column:
    """The last part of a namespaced id; others are themselves."""
    return F.when(F.contains(native, F.lit(":message:")), F.element_at(F.split(native, ":message:"), -1)).when(F.contains(native, F.lit(":entry:")), F.element_at(F.split(native, ":entry:"), -1)).otherwise(F.regexp_replace(native, "^entry:", ""))


def backfill_by_suffix(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``rows`` with a missing ``seq`` taken from the event with the same id, or the same bare id if only one full id has it."""
    first = events.filter(F.col("message_id") != "").groupBy("session", "message_id").agg(F.min("seq").alias("_full"))
    bare = first.withColumn("_b", bare_id(F.col("message_id"))).groupBy("session", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_full").alias("_bare")).filter("_n = 1").drop("_n")
    joined = rows.join(first, ["session", "message_id"], "left").withColumn("_b", bare_id(F.col("message_id"))).join(bare, ["session", "_b"], "left")
    return joined.withColumn("seq", F.coalesce("seq", "_full", "_bare")).drop("_b", "_full", "_bare")


def with_turn_ids(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Events with the ``turn_id`` of the turn whose span holds them; events outside any span keep their own.

    ``events`` has ``turn_index`` (see ``with_turn_index``), so this is an equal join.
    """
    ids = turns.select("session", "turn_index", F.col("turn_id").alias("_t"))
    return events.join(ids, ["session", "turn_index"], "left").withColumn("turn_id", F.coalesce("_t", "turn_id")).drop("_t")


def sequence_faults(events: DataFrame) -> DataFrame:
    """``session, expected, found``: sessions whose numbers aren't 1 to n, by count, least, most and distinct (no sort).

    ``found`` is the number of distinct sequence numbers.
    """
    seen = events.groupBy("session").agg(F.count(F.lit(1)).alias("expected"), F.countDistinct("seq").alias("found"), F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    return seen.filter((F.col("_lo") != 1) | (F.col("_hi") != F.col("expected")) | (F.col("found") != F.col("expected"))).select("session", "expected", "found")


def evidence_counts(events: DataFrame) -> DataFrame:
    """``session`` and how many of its claims are native, inferred or unknown."""
    return events.groupBy("session").agg(*[F.count_if(F.coalesce(F.col("evidence"), F.lit("unknown")) == e).alias(f"n_{e}") for e in ("native", "inferred", "unknown")])


def violations_by_rule(checks: dict[str, DataFrame]) -> DataFrame:
    """``rule, n`` over tables of violations; a rule without any has 0."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in checks.items()]
    return union_sources(*counted)


def encode_cursor(generation: str, offset: int, bound: str = "") -> str:
    """A page token: it is only good for the generation and the question it was made for."""
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "gen": generation, "q": bound, "off": offset}, sort_keys=True).encode()).decode()


def decode_cursor(token: str, generation: str, bound: str = "") -> int:
    """The offset of a page token; a token of another generation or question is refused."""
    try:
        held = json.loads(base64.urlsafe_b64decode(token.encode()))
        version, gen, asked, offset = held["v"], held["gen"], held["q"], held["off"]
    except (ValueError, KeyError, TypeError) as fault:
        raise ValueError("no such cursor") from fault
    if version != 1 or not isinstance(offset, int) or isinstance(offset, bool) or offset < 0:
        raise ValueError("no such cursor")
    if gen != generation or asked != bound:
        raise ValueError("stale cursor")
    return offset


def page_after(df: DataFrame, order: list[str], generation: str, token: str | None = None, size: int = 100, bound: str = "") -> tuple[DataFrame, str]:
    """The page that a token stands for (the first without one), of 1 to 1000 rows, and the next page's token."""
    if not 1 <= size <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    offset = 0 if token is None else decode_cursor(token, generation, bound)
    return df.orderBy(*order).offset(offset).limit(size), encode_cursor(generation, offset + size, bound)


def page_before(messages: DataFrame, before: int | None = None, size: int = 50) -> DataFrame:
    """The ``size`` (1 to 200) messages of every session that stand before place ``before``, counted from 0; the last ones without it."""
    size = max(1, min(200, size))
    total = messages.groupBy("session").agg(F.count(F.lit(1)).alias("_n"))
    rows = meet(running_sum(messages, ["session"], "seq", F.lit(1), "place").withColumn("place", (F.col("place") - 1).cast("int")), total, ["session"])
    end = F.col("_n") if before is None else F.least(F.col("_n"), F.lit(max(0, before)))
    return rows.filter((F.col("place") < end) & (F.col("place") >= end - size)).drop("_n")


def resolve_reference(sessions: DataFrame, ref: str, short: int = 8, most: int = 10) -> DataFrame:
    """``verdict, n, candidates`` of a reference: one row, ``found``, ``ambiguous`` or ``not_found``.

    ``ref`` is an id, its beginning, or a short id, after ``source:`` or not; an
    equal id wins over others that only begin with it.  ``candidates`` are the
    first keys by name, at most ``most`` (a report).
    """
    source, _, ident = ref.partition(":") if ":" in ref else ("", "", ref)
    fits = (F.col("id") == ident) | F.startswith("id", F.lit(ident)) | (F.substring("id", 1, short) == ident)
    some = sessions.filter(fits & (F.lit(source == "") | (F.col("source") == source)) & F.lit(ident != ""))
    keyed = some.select(F.concat_ws(":", "source", "id").alias("key"), (F.col("id") == ident).alias("exact"))
    counts = keyed.agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("exact"), F.min(F.when(F.col("exact"), F.col("key"))).alias("best"))
    first = keyed.orderBy("key").limit(most).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    found = (F.col("exact") == 1) | (F.col("n") == 1)
    verdict = F.when(F.col("n") == 0, "not_found").when(found, "found").otherwise("ambiguous")
    return counts.crossJoin(F.broadcast(first)).select(verdict.alias("verdict"), "n", F.when(F.col("exact") == 1, F.array("best")).otherwise(F.col("keys")).alias("candidates"))  # one row each


def weighted_rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens a second over all rows that have both counts and a duration: summed tokens by summed time, never a mean of rates."""
    both = rows.filter((F.col("tokens") >= 0) & (F.col("duration_ms") > 0))
    sums = both.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration_ms"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("tokens_per_second", F.col("tokens") * 1000 / F.col("duration_ms"))


def first_requests(requests: DataFrame) -> DataFrame:
    """``session, id, start, end``: the first request of an id counts, up to its latest end."""
    return requests.groupBy("session", "id").agg(F.min_by("start", "pos").alias("start"), F.max("end").alias("end"))


def performance_summary(records: DataFrame, most: int = 25) -> DataFrame:
    """``session, n, kinds, latest``: counts, the distinct kinds in the order they came up (at most ``most``, a report), the latest record; durations are never added or averaged."""
    kinds = records.groupBy("session", "kind").agg(F.min("pos").alias("_p"))
    rank = F.row_number().over(Window.partitionBy("session").orderBy("_p", "kind"))
    listed = kinds.withColumn("_r", rank).filter(F.col("_r") <= most).groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "kind"))), lambda x: x["kind"]).alias("kinds"))
    sums = records.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max_by("record", "pos").alias("latest"))
    return sums.join(listed, "session")


def version_marks(rows: DataFrame) -> DataFrame:
    """``session`` and what changes whenever its rows do: count, latest, and sums of times, numbers and bytes."""
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("updated").alias("latest"), F.sum("updated").alias("sum_updated"), F.sum("seq").alias("sum_seq"), F.sum(F.octet_length("text")).alias("n_bytes"))
