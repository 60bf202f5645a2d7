"""The dialect of two tables, messages and their parts, joined into the one event log.

``messages(session, id, created, data)`` and ``parts(message_id, id, created,
data)``; ``created`` is in milliseconds, ``data`` a JSON text.  Rows are in the
order of the message's time, its id and the part's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.guards import stripped
from loglattice.functions.text import with_classification
from loglattice.operators.filters import prefer_first
from loglattice.operators.ordered import bound, numbered_within
from loglattice.sources.shared import settle

COLUMNS = ("type", "text", "origin", "call_id", "message_id", "name", "result_status", "error_name", "error_code")
_LAST = 1 << 62


def _get(of: str, path: str) -> Column:
    return F.try_variant_get(of, path, "string")


def _filled(*values: Column) -> Column:
    """The first value that isn't blank, without white space at its ends; ``nullif`` would strip each twice."""
    return F.coalesce(*[F.when(v.rlike(r"[^\s\p{Z}]"), stripped(v)) for v in values])


def _event(pos: Column, mid: Column, pid: Column, k: int, **values: Column) -> Column:
    place = F.struct(mid.alias("mid"), pid.alias("pid"), F.lit(k).alias("k")).alias("sub")
    return F.struct(pos.alias("pos"), place, *[values.get(c, F.lit(None)).cast("string").alias(c) for c in COLUMNS])


def _messages(messages: DataFrame) -> DataFrame:
    """Messages that are objects: their role, their error, and whether they stopped by themselves; ``once`` is one row of those with equal ids."""
    held = messages.select("session", F.col("id").alias("mid"), F.col("created").alias("at"), "data", F.try_parse_json("data").alias("m"))
    held = held.select("session", "mid", "at", (F.col("m").isNotNull() & F.col("data").rlike(r"^\s*\{")).alias("object"), _get("m", "$.role").alias("role"), F.coalesce(_get("m", "$.finish") == "stop", F.lit(False)).alias("stopped"), F.try_variant_get("m", "$.error", "variant").alias("error"))
    # Behind the generator every message is parsed once, not again for the filter; most have no error, and nothing is looked for in those.
    held = bound(held).filter("object").drop("object")
    within = lambda column: F.when(F.col("error").isNotNull(), column)
    # an error's own words, else its name; the name, else what its words tell
    held = held.withColumns({"told": within(_filled(_get("error", "$.data.message"))), "status": within(F.try_variant_get("error", "$.data.statusCode", "int"))})
    told = F.when(F.col("status").between(100, 599), F.concat(F.col("status").cast("string"), F.lit(": "), F.col("told"))).otherwise(F.col("told"))
    plain = F.when(F.schema_of_variant("error") == "STRING", _get("error", "$"))
    said = F.coalesce(told, _filled(_get("error", "$.message"), plain, _get("error", "$.text"), _get("error", "$.name")))
    code = _filled(_get("error", "$.data.statusCode"), _get("error", "$.data.status"), _get("error", "$.statusCode"), _get("error", "$.status"))
    read = held.select("session", "mid", "at", "role", "stopped", within(said).alias("failure"), within(code).alias("error_code"), within(_filled(_get("error", "$.type"), _get("error", "$.name"))).alias("error_name"))
    name = F.coalesce("error_name", F.when(F.contains(F.lower("failure"), F.lit("abort")), "aborted").otherwise("provider"))
    failed = F.col("failure").isNotNull()
    read = read.withColumns({"error_name": F.when(failed, name), "error_code": F.when(failed, F.col("error_code"))})
    failing = F.coalesce(failed & (F.col("role") == "assistant"), F.lit(False))
    same = Window.partitionBy("mid", "session").orderBy(failing.desc(), "at", "failure", "error_name", "error_code")
    return read.repartition("mid").withColumn("once", F.row_number().over(same) == 1)


def _parts(parts: DataFrame) -> DataFrame:
    """What parts give: ``kind`` is null for synthetic ones (and those that are no objects have none); ``silent`` is one row of each message that has no text among its parts."""
    held = parts.filter("message_id is not null").select(F.col("message_id").alias("mid"), F.col("id").alias("pid"), F.try_parse_json("data").alias("p"))
    synthetic = F.coalesce(_get("p", "$.synthetic").isin("true", "1"), F.lit(False))
    held = held.withColumn("kind", F.when(~synthetic, _get("p", "$.type")))
    kind, text, state = F.col("kind"), stripped(_get("p", "$.text")), F.col("state")
    tool = kind == "tool"
    words = F.when(kind.isin("text", "reasoning"), text).when(kind == "compaction", _filled(text, _get("p", "$.state.summary"), _get("p", "$.state.text")))
    held = held.withColumns({"state": F.when(tool, _get("p", "$.state.status")), "words": words})
    held = held.select(
        "mid", "pid", "kind", "words", F.when(tool, _filled(_get("p", "$.callID"), F.col("pid"))).alias("call"), F.when(tool, F.coalesce(_filled(_get("p", "$.tool")), F.lit("tool"))).alias("tool"), "state",
        F.when(state == "error", _get("p", "$.state.error")).when(state == "completed", _get("p", "$.state.output")).alias("output"), F.lit(True).alias("has"),
    )
    spoken = F.coalesce((kind == "text") & (F.length("words") > 0), F.lit(False))
    return held.withColumn("silent", (F.row_number().over(Window.partitionBy("mid").orderBy(spoken.desc(), "pid")) == 1) & ~spoken)


def joined(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages with what their parts give; a message without parts keeps one row, one that is no object has none.

    Both are parsed before they meet, and neither is read twice: windows over the parts of a message share the join's shuffle.
    """
    return _messages(messages).join(_parts(parts), "mid", "left")


def _classified(log: DataFrame) -> DataFrame:
    failed = F.col("error_name").isNotNull()
    judged = with_classification(log, F.col("error_name"), F.when(failed, F.col("error_code")), F.when(failed, F.col("text")))  # rules look at failures only
    return judged.withColumns({"error_kind": F.when(failed, F.col("error_kind")), "retryable": F.when(failed, F.col("retryable"))}).drop("error_name")


def events(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """The event log.

    A tool part is a call and, once it is done, its result; synthetic parts and
    blank texts give nothing.  A message without parts gives its error, or a mark
    if it didn't stop by itself.  An error of a message whose parts hold no text
    of the assistant comes out at the end of the session.
    """
    rows = joined(messages, parts)
    kind, mid, pid, call = F.col("kind"), F.col("mid"), F.col("pid"), F.col("call")
    assistant, failed, empty, tool = F.col("role") == "assistant", F.col("failure").isNotNull(), F.col("has").isNull(), kind == "tool"
    at = F.col("at").cast("long")
    own = (
        F.when(empty, F.when(assistant & failed, "assistant_message").when(assistant & ~F.col("stopped"), "lifecycle"))
        .when((kind == "text") & (F.col("role") == "user"), "user_message").when((kind == "text") & assistant, "assistant_message")
        .when(kind.isin("reasoning", "compaction"), "thinking").when(tool, "tool_call")
    )
    text = F.when(~empty, F.col("words")).when(failed, F.col("failure")).otherwise("empty assistant message")
    rows = rows.withColumns({"own": own, "own_text": text})
    own, text = F.col("own"), F.col("own_text")
    failing = {c: F.when(own == "assistant_message", F.col(c)) for c in ("error_name", "error_code")}
    first = _event(at, mid, pid, 0, type=own, text=text, origin=F.when(own == "user_message", "human"), call_id=call, message_id=mid, name=F.col("tool"), **failing)
    done = _event(at, mid, pid, 1, type=F.lit("tool_result"), call_id=call, text=F.col("output"), message_id=mid, result_status=F.when(F.col("state") == "error", "error").otherwise("ok"))
    late = _event(F.lit(_LAST), F.concat(F.lpad(at.cast("string"), 20, "0"), mid), F.lit(""), 0, type=F.lit("assistant_message"), text=F.col("failure"), message_id=mid, error_name=F.col("error_name"), error_code=F.col("error_code"))
    made = F.array(
        F.when((own == "tool_call") | (F.length(text) > 0) & own.isNotNull(), first),
        F.when(tool & F.col("state").isin("completed", "error"), done),
        F.when(assistant & failed & F.col("silent") & F.col("once"), late),
    )
    # The number needs the events twice, so they are worked out once and kept.
    spread = settle(rows.select("session", F.explode(made).alias("e")).filter("e is not null").select("session", "e.*"), "store-events")
    return _classified(numbered_within(spread, ["session"], "pos", "sub", "seq").drop("pos", "sub"))


def conversation(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """``session, at, mid, pid, role, text`` of all text parts that aren't synthetic."""
    return joined(messages, parts).filter("kind = 'text'").select("session", "at", "mid", "pid", "role", F.col("words").alias("text"))


def all_sessions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sessions of both layouts; what the first layout has, the second doesn't add."""
    return prefer_first(first, second, "id")
