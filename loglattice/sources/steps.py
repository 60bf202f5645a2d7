"""The dialect of step transcripts: results name a step, or are taken in turn.

``rows`` has ``session, pos, raw``; lines without a ``step_index`` and a ``type`` are left
out.  A call of step s at place k answers to step s + 1 + k.  Within a stretch from one
user input to the next, a result takes the open call of its step, else the earliest
open call.  Where every result of a stretch finds its step's only call before it, an
equal join pairs them; other stretches are walked through, each on its own, so a task
holds the open calls of one stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.guards import stripped
from loglattice.operators.ordered import carry_forward, meet, numbered_within, running_sum
from loglattice.sources.blobs import _at, _is, _string, event
from loglattice.sources.claude import field, parsed
from loglattice.sources.shared import settle

# Kinds of lines, and statuses of a line that broke off.
RESULTS = ("RUN_COMMAND", "VIEW_FILE", "LIST_DIRECTORY", "CODE_ACTION", "SEARCH_WEB", "GREP_SEARCH", "GENERIC")
OTHERS = ("PLANNER_RESPONSE", "USER_INPUT", "CHECKPOINT", "SYSTEM_MESSAGE", "ERROR_MESSAGE")
ABORTED = ("ERROR", "CANCELED", "CANCELLED")
MODEL = r"`Model Selection`\s+from\s+.+?\s+to\s+(.+?)(?:\.(?=\s|<|$)|(?=<)|(?=\n)|$)"

#: JSON values that count as nothing.
EMPTY = ("null", "false", "0", '""', "[]", "{}")
_EVENT = "struct<type:string,text:string,origin:string,call_id:string,name:string,result_status:string,error:string>"
FIELDS = ("type", "text", "origin", "call_id", "name", "result_status", "error")
COLUMNS = (*FIELDS, "model")
_PAIRED = "session string, part long, call_id string, result_pos long"


def _trimmed(path: str) -> Column:
    return F.coalesce(stripped(_string(field(path, "variant"))), F.lit(""))


def typed_text(content: Column) -> Column:
    """The request inside a user's line: what its tag holds, else what stands before the notes."""
    inner = F.regexp_extract(content, "(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1)
    tagged = (F.instr(content, "<USER_REQUEST>") > 0) & (F.instr(content, "</USER_REQUEST>") > F.instr(content, "<USER_REQUEST>"))
    bare = F.regexp_replace(F.regexp_replace(content, "(?s)<ADDITIONAL_METADATA>.*", ""), "(?s)<USER_SETTINGS_CHANGE>.*", "")
    return stripped(F.when(tagged, inner).otherwise(bare))


def chosen_model(content: Column) -> Column:
    """The model that the last note of changed settings names."""
    block = F.substring_index(F.substring_index(content, "<USER_SETTINGS_CHANGE>", -1), "</USER_SETTINGS_CHANGE>", 1)
    name = stripped(F.regexp_replace(stripped(F.regexp_extract(block, MODEL, 1)), r"\.+$", ""))
    return F.when(F.contains(content, F.lit("<USER_SETTINGS_CHANGE>")), F.nullif(name, F.lit("")))


def _media() -> Column:
    """Attachments as text, one a line."""
    entries = F.when(_is(field("$.media", "variant"), "ARRAY"), field("$.media", "array<variant>"))
    part = lambda m, p: F.nullif(stripped(_string(_at(m, p, "variant"))), F.lit(""))
    each = F.transform(entries, lambda m: F.when(F.coalesce(part(m, "$.mime_type"), part(m, "$.uri")).isNotNull(), F.concat_ws(" ", F.concat(F.lit("["), F.coalesce(part(m, "$.mime_type"), F.lit("media")), F.lit("]")), part(m, "$.uri"))))
    return F.coalesce(F.array_join(F.array_compact(each), "\n"), F.lit(""))


def _lines(rows: DataFrame) -> DataFrame:
    held = parsed(rows).filter(field("$.step_index", "variant").isNotNull() & _is(field("$.type", "variant"), "STRING"))
    step = F.when(F.schema_of_variant(field("$.step_index", "variant")) == "BIGINT", field("$.step_index", "long"))
    status = F.upper(F.coalesce(field("$.status"), F.lit("")))
    content = F.coalesce(_string(field("$.content", "variant")), F.lit(""))
    held = held.select("session", "pos", "v", field("$.type").alias("kind"), F.coalesce(field("$.source"), F.lit("")).alias("source"), status.alias("status"), step.alias("step"), content.alias("content"), _media().alias("media"))
    aborted = F.col("status").isin(*ABORTED)
    failure = F.coalesce(F.nullif(_trimmed("$.error"), F.lit("")), F.when(aborted, F.nullif(stripped(F.col("content")), F.lit(""))))
    held = held.withColumns({"aborted": aborted, "failure": failure, "breaks": F.coalesce(failure, F.when(F.contains("status", F.lit("CANCEL")), "canceled").otherwise("error"))})
    held = held.withColumn("is_result", ~F.col("kind").isin(*OTHERS) & (F.col("kind").isin(*RESULTS) | (F.col("source") == "MODEL")))
    held = carry_forward(held, ["session"], "pos", F.when(F.col("kind") == "USER_INPUT", chosen_model(F.col("content"))), "model")
    return running_sum(held, ["session"], "pos", F.when(F.col("kind") == "USER_INPUT", 1).otherwise(0), "part")


def _calls(lines: DataFrame) -> DataFrame:
    """Calls with their ids; an id that an earlier call has gets the line's number."""
    listed = F.when(_is(field("$.tool_calls", "variant"), "ARRAY"), field("$.tool_calls", "array<variant>"))
    spread = lines.filter("kind = 'PLANNER_RESPONSE'").select("session", "pos", "part", "step", "model", F.posexplode(listed).alias("k", "c")).filter(_is(F.col("c"), "OBJECT"))
    base = F.concat_ws("-", F.coalesce(F.col("step"), F.col("k")), F.col("k"))
    spread = spread.select("session", "pos", "part", "step", "model", "k", base.alias("base"), F.coalesce(F.nullif(_at(F.col("c"), "$.name"), F.lit("")), F.lit("tool")).alias("name"))
    firsts = spread.groupBy("session", "base").agg(F.min(F.struct("pos", "k")).alias("first"))
    own = F.when(F.col("first") == F.struct("pos", "k"), F.col("base")).otherwise(F.concat_ws(":", "base", "pos"))
    return meet(spread, firsts, ["session", "base"]).select("session", "pos", "part", "k", "name", "model", own.alias("call_id"), (F.col("step") + 1 + F.col("k")).alias("target"))


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of stretches that are no plain join, sorted by session, stretch and place."""
    at, queue, steps = None, {}, {}
    for frame in frames:
        out = []
        held = frame.astype(object)
        for session, part, pos, opens, step, call_id in held.where(held.notna(), None)[["session", "part", "pos", "opens", "step", "call_id"]].itertuples(index=False, name=None):
            if at != (session, part):
                at, queue, steps = (session, part), {}, {}
            if opens:
                queue[call_id] = None
                if step is not None:
                    steps[step] = call_id
                continue
            found = steps.pop(step, None) if step is not None else None
            if found is None and queue:
                found = next(iter(queue))
                steps = {k: v for k, v in steps.items() if v != found}
            queue.pop(found, None)
            if found is not None:
                out.append((session, part, found, pos))
        yield pd.DataFrame(out, columns=["session", "part", "call_id", "result_pos"])


def matched(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``session, part, call_id, result_pos`` of the results that have a call."""
    opens = calls.select("session", "part", "pos", "k", F.lit(True).alias("opens"), F.col("target").alias("step"), "call_id")
    closes = results.select("session", "part", "pos", F.lit(0).alias("k"), F.lit(False).alias("opens"), "step", F.lit(None).cast("string").alias("call_id"))
    every = opens.unionByName(closes)
    by_step = every.groupBy("session", "part", "step").agg(
        F.count_if("opens").alias("n_calls"), F.count_if(~F.col("opens")).alias("n_results"), F.max(F.when(F.col("opens"), F.struct("pos", "call_id"))).alias("call"), F.max(F.when(~F.col("opens"), F.col("pos"))).alias("result_pos"),
    )
    plain = (F.col("n_results") == 0) & (F.col("n_calls") <= 1) | (F.col("step").isNotNull() & (F.col("n_calls") == 1) & (F.col("n_results") == 1) & (F.col("call.pos") < F.col("result_pos")))
    stretches = by_step.groupBy("session", "part").agg(F.bool_and(plain).alias("plain"))
    joined = meet(by_step.filter("n_results = 1 and n_calls = 1"), stretches.filter("plain"), ["session", "part"]).select("session", "part", F.col("call.call_id").alias("call_id"), "result_pos")
    rest = meet(every, stretches.filter("not plain"), ["session", "part"]).drop("plain")
    walked = rest.repartition("session", "part").sortWithinPartitions("session", "part", "pos", "k").mapInPandas(_walk, _PAIRED)
    return joined.select("session", "part", "call_id", F.col("result_pos").cast("long")).unionByName(walked)


def events(rows: DataFrame) -> DataFrame:
    """The event log: ``session, seq`` and :data:`COLUMNS`; ``error`` is the text of an upstream error.

    Blank texts give nothing, nor does a result without output and without a call; a null
    session is a session; repeated rows give repeated events.
    """
    lines = settle(_lines(rows), "step-lines")
    calls = settle(_calls(lines), "step-calls")
    results = lines.filter("is_result")
    pairs = matched(calls, results.select("session", "part", "pos", "step"))
    pairs = pairs.select("session", F.col("result_pos").alias("pos"), "call_id")
    make = lambda kind, **values: event(F.lit(kind), FIELDS, _EVENT, **values)
    none = F.array().cast(f"array<{_EVENT}>")
    some = lambda condition, made: F.when(condition, F.array(made)).otherwise(none)
    broken = make("assistant_message", text=F.col("breaks"), error=F.col("breaks"))
    text = typed_text(F.col("content"))
    origin = F.when(F.col("source") == "USER_EXPLICIT", "human").when(F.col("source") == "SYSTEM", "system").otherwise("unknown")
    asked = F.when((text != "") & (text != "None"), F.array(make("user_message", text=text, origin=origin))).when(F.col("media") != "", F.array(make("user_message", text=F.col("media"), origin=origin))).otherwise(some(F.col("aborted"), broken))
    said = F.nullif(F.nullif(stripped(F.col("content")), F.lit("None")), F.lit(""))
    thought = _trimmed("$.thinking")
    spoken = F.when(F.col("aborted") & said.isNull(), F.array(broken)).when(said.isNotNull(), F.array(make("assistant_message", text=said, error=F.when(F.col("aborted"), F.col("failure"))))).otherwise(
        some((F.col("media") != "") & F.coalesce(F.to_json(field("$.tool_calls", "variant")), F.lit("null")).isin(*EMPTY), make("assistant_message", text=F.col("media")))
    )
    answer = F.concat(some(thought != "", make("thinking", text=thought)), spoken)
    made = (
        F.when(F.col("kind") == "USER_INPUT", asked).when(F.col("kind") == "SYSTEM_MESSAGE", some(F.col("aborted"), broken)).when(F.col("kind") == "CHECKPOINT", F.array(make("compaction", text=F.nullif(stripped(F.col("content")), F.lit("")))))
        .when(F.col("kind") == "PLANNER_RESPONSE", answer).when(F.col("is_result"), none).otherwise(some((F.col("kind") == "ERROR_MESSAGE") | F.col("aborted"), broken))
    )
    spread = lines.select("session", "pos", "model", F.posexplode(made).alias("sub", "e")).select("session", "pos", "sub", "e.*", "model")
    blank = F.lit(None).cast("string")
    called = calls.select("session", "pos", (F.col("k") + 100).alias("sub"), F.lit("tool_call").alias("type"), blank.alias("text"), blank.alias("origin"), "call_id", "name", blank.alias("result_status"), blank.alias("error"), "model")
    outcome = F.when(F.col("status") == "DONE", "ok").when(F.col("status").isin("ERROR", "INVALID"), "error").otherwise("unknown")
    output = F.coalesce(F.nullif(stripped(F.col("content")), F.lit("")), F.nullif(_trimmed("$.error"), F.lit("")), F.when(F.col("status").isin("ERROR", "INVALID"), F.lower("status")), F.lit(""))
    output = F.concat_ws("\n", F.nullif(output, F.lit("")), F.nullif(F.col("media"), F.lit("")))
    answered = meet(results.select("session", "pos", F.lit(0).alias("sub"), F.lit("tool_result").alias("type"), output.alias("text"), blank.alias("origin"), blank.alias("name"), outcome.alias("result_status"), blank.alias("error"), "model"), pairs, ["session", "pos"], "left")
    answered = answered.withColumn("call_id", F.coalesce("call_id", F.lit(""))).filter("text <> '' or call_id <> ''")
    shown = ["session", "pos", "sub", *COLUMNS]
    every = spread.select(shown).unionByName(called.select(shown)).unionByName(answered.select(shown)).filter("type in ('tool_call', 'tool_result', 'compaction') or text <> ''")
    return numbered_within(every, ["session"], "pos", "sub", "seq").select("session", "seq", *COLUMNS)
