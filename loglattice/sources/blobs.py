"""The dialect of message blobs: rows of a store whose tool results may stand before their calls.

``rows`` has ``session, pos, raw``; only JSON objects are messages.  A result whose call
comes later is shown right after the call, and of several such results the last; once
its call has been seen, a result stands where it is; results whose call never comes
are shown at the end, in the order of their ids' first results.  All of that follows
from one aggregation by id (its first call, its last early result), so no session is
walked through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.guards import stripped
from loglattice.operators.ordered import meet, numbered_within
from loglattice.sources.claude import FAILED, field, parsed

# The beginning of a replayed summary and the tag around what was typed.
SUMMARY = "[Previous conversation summary]:"
QUERY = r"(?s)<user_query>\s*(.*?)\s*</user_query>"
#: Without the tag, a longer text is context, and so is one with a tag in its first characters.
LONGEST_PLAIN, TAG_WITHIN = 2000, 80

_LAST = (1 << 62) - 1
_EVENT = "struct<type:string,text:string,origin:string,call_id:string,name:string,result_status:string,model:string>"
COLUMNS = ("type", "text", "origin", "call_id", "name", "result_status", "model")


def _at(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _string(value: Column) -> Column:
    return F.when(_is(value, "STRING"), _at(value, "$"))


def event(kind: Column, columns: tuple[str, ...] = COLUMNS, struct: str = _EVENT, **values: Column) -> Column:
    """An event with the given fields; the others are null."""
    given = {"type": kind} | values
    return F.struct(*[given.get(c, F.lit(None)).cast("string").alias(c) for c in columns]).cast(struct)


def shown(value: Column) -> Column:
    """A native value as text: a string as it is, anything else as JSON."""
    return F.coalesce(_string(value), F.to_json(value))


def status_of(output: Column) -> Column:
    """``error`` where the beginning of a text output tells of a failure, else ``unknown``."""
    return F.when(F.substring(_string(output), 1, 600).rlike(FAILED), "error").otherwise("unknown")


def _said(content: Column, listed: Column) -> Column:
    """Text of a content: a string, or the text parts of a list, one a line."""
    pieces = F.transform(listed, lambda p: F.coalesce(_string(p), F.when(F.coalesce(_at(p, "$.type") == "text", _at(p, "$.type", "variant").isNull()) & _is(p, "OBJECT"), _at(p, "$.text"))))
    return F.coalesce(_string(content), F.array_join(F.filter(pieces, lambda t: t != ""), "\n"))


def _typed(raw: Column) -> Column:
    """What a human typed of a user's text; null if none of it."""
    tagged = raw.rlike(QUERY)
    plain = F.when(~F.contains(F.substring(raw, 1, TAG_WITHIN), F.lit("<")) & (F.length(raw) <= LONGEST_PLAIN), stripped(raw))
    text = F.when(tagged, stripped(F.regexp_extract(raw, QUERY, 1))).otherwise(plain)
    return F.when(~F.startswith(F.ltrim(raw), F.lit(SUMMARY)), F.nullif(text, F.lit("")))


def _messages(rows: DataFrame) -> DataFrame:
    """Each message's events, in their order within it."""
    held = parsed(rows).select("session", "pos", "v", field("$.role").alias("role"), F.try_variant_get("v", "$.content", "variant").alias("content"))
    held = held.withColumn("listed", F.when(_is(F.col("content"), "ARRAY"), _at(F.col("content"), "$", "array<variant>")))
    held = held.withColumn("raw", F.when(F.col("role") == "user", _said(F.col("content"), F.col("listed"))))
    held = held.withColumn("typed", _typed(F.col("raw")))
    models = F.filter(F.transform("listed", lambda p: F.nullif(stripped(_string(_at(p, "$.providerOptions.cursor.modelName", "variant"))), F.lit(""))), lambda m: m.isNotNull())
    held = held.withColumn("model", F.when(F.col("role") == "assistant", F.get(models, 0)))
    none = F.array().cast(f"array<{_EVENT}>")
    user = F.when(F.col("typed").isNotNull(), F.array(event(F.lit("user_message"), text=F.col("typed"), origin=F.lit("human")))).when(F.length(stripped(F.col("raw"))) > 0, F.array(event(F.lit("user_message"), text=stripped(F.col("raw")), origin=F.lit("injected")))).otherwise(none)
    kind = lambda p: F.when(_at(p, "$.type").isin("thinking", "reasoning"), "thinking").when(_at(p, "$.type") == "text", "assistant_message").when(_at(p, "$.type") == "tool-call", "tool_call")
    words = lambda p: stripped(F.coalesce(F.nullif(_at(p, "$.text"), F.lit("")), F.when(kind(p) == "thinking", _at(p, "$.thinking")), F.lit("")))
    call = lambda p: event(F.lit("tool_call"), call_id=F.coalesce(_at(p, "$.toolCallId"), F.lit("")), name=F.coalesce(F.nullif(_at(p, "$.toolName"), F.lit("")), F.lit("tool")))
    parts = F.transform(F.filter("listed", lambda p: kind(p).isNotNull()), lambda p: F.when(kind(p) == "tool_call", call(p)).otherwise(event(kind(p), text=words(p), model=F.col("model"))))
    spoken = F.coalesce(parts, F.array(event(F.lit("assistant_message"), text=stripped(F.coalesce(_string(F.col("content")), F.lit(""))))))
    results = F.transform(F.filter("listed", lambda p: _at(p, "$.type") == "tool-result"), lambda p: event(F.lit("tool_result"), text=shown(_at(p, "$.result", "variant")), call_id=F.coalesce(_at(p, "$.toolCallId"), F.lit("")), result_status=status_of(_at(p, "$.result", "variant"))))
    made = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", spoken).when(F.col("role") == "tool", F.coalesce(results, none)).otherwise(none)
    spread = held.select("session", "pos", F.posexplode(made).alias("sub", "e")).select("session", "pos", "sub", "e.*")
    return spread.filter(F.col("type").isin("tool_call", "tool_result") | (F.length("text") > 0))


def events(rows: DataFrame) -> DataFrame:
    """The event log: ``session, seq, pos`` (the native row) and :data:`COLUMNS`.

    Results without an id stand where they are; repeated rows give repeated events; a
    null session is a session; blank texts and rows that are no messages give nothing.
    """
    spread = _messages(rows)
    place = F.struct("pos", "sub")
    ids = spread.filter("call_id <> ''").groupBy("session", "call_id").agg(F.min(F.when(F.col("type") == "tool_call", place)).alias("call"))
    known = spread.filter("type = 'tool_result' and call_id <> ''")
    known = meet(known, ids, ["session", "call_id"]).withColumn("early", F.col("call").isNull() | (place < F.col("call")))
    in_place = spread.filter("type <> 'tool_result' or call_id = ''").withColumns({"at": F.col("pos"), "place": F.col("sub").cast("long"), "after": F.lit(0)})
    late = known.filter("not early").withColumns({"at": F.col("pos"), "place": F.col("sub").cast("long"), "after": F.lit(0)})
    held = known.filter("early").groupBy("session", "call_id").agg(F.max_by(F.struct("pos", "sub", *[c for c in COLUMNS if c != "call_id"]), place).alias("r"), F.min(place).alias("first"), F.first("call").alias("call"))
    early = held.select(
        "session", "r.pos", "r.sub", *[F.col("call_id") if c == "call_id" else F.col(f"r.{c}") for c in COLUMNS],
        F.coalesce("call.pos", F.lit(_LAST)).alias("at"), F.when(F.col("call").isNull(), F.col("first.pos")).otherwise(F.col("call.sub")).cast("long").alias("place"), F.when(F.col("call").isNull(), F.col("first.sub")).otherwise(1).alias("after"),
    )
    columns = ["session", "pos", "at", "place", "after", *COLUMNS]
    every = in_place.select(columns).unionByName(late.select(columns)).unionByName(early.select(columns)).withColumn("within", F.struct("place", "after"))
    return numbered_within(every, ["session"], "at", "within", "seq").select("session", "seq", "pos", *COLUMNS)
