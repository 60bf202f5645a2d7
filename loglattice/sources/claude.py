"""The dialect of message lines with content parts: events, and what its lines say about usage.

``rows`` has ``session, pos, raw``.  Lines are parsed once, into VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.guards import label, stripped
from loglattice.functions.text import with_classification
from loglattice.operators.ordered import carry_forward, numbered_within

# Beginnings of text that no human typed, and the marks of an interrupt.
SKIPPED = ("<local-command", "<command-name>", "<command-message>", "<bash-input>", "<bash-stdout>", "<bash-stderr>")
INTERRUPTED = ("[Request interrupted by user]", "[Request interrupted by user for tool use]")
#: Fixed value: beginnings of lines that tell of a failed tool.
FAILED = r"(?im)^(?:exit code:?\s*[1-9]|error:|traceback \(most recent call last\)|command failed|fatal:)"

_PART = "array<struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,content:variant,is_error:variant>>"
_EVENT = "struct<type:string,text:string,origin:string,call_id:string,message_id:string,name:string,result_status:string,error_code:string>"
COLUMNS = ("type", "text", "origin", "call_id", "message_id", "name", "result_status", "error_code")
_LAST = 1 << 62


def field(path: str, kind: str = "string") -> Column:
    """A native field of the line."""
    return F.try_variant_get("v", path, kind)


def flag(path: str) -> Column:
    """Whether a native field is the boolean true (and nothing like it)."""
    return F.coalesce((F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "BOOLEAN") & field(path, "boolean"), F.lit(False))


def parsed(rows: DataFrame) -> DataFrame:
    """Lines with ``v``, their parsed form; lines that are no JSON object are left out."""
    held = rows.select("session", "pos", F.try_parse_json("raw").alias("v"))
    return held.filter(F.schema_of_variant("v").startswith("OBJECT"))


def result_status(explicit: Column, output: Column) -> Column:
    """A tool result's status: the native flag, else unknown for empty output, else what the output's beginning says."""
    kind = F.schema_of_variant(explicit)
    text = F.when(F.schema_of_variant(output) == "STRING", F.try_variant_get(output, "$", "string")).otherwise(F.to_json(output))
    empty = output.isNull() | F.is_variant_null(output) | (F.length(stripped(text)) == 0) | text.isin("[]", "{}")
    said = F.when(F.coalesce(empty, F.lit(True)), "unknown").when(F.substring(text, 1, 600).rlike(FAILED), "error").otherwise("ok")
    return F.when(kind == "BOOLEAN", F.when(F.try_variant_get(explicit, "$", "boolean"), "error").otherwise("ok")).otherwise(said)


def said_text(plain: Column, parts: Column) -> Column:
    """What a human typed: text parts joined with blanks, arguments of commands, no echoes and no tagged notes."""
    joined = F.array_join(F.filter(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: stripped(F.coalesce(p["text"], F.lit("")))), lambda t: t != ""), " ")
    whole = F.coalesce(stripped(plain), joined)
    called = F.regexp_extract(whole, r"<command-name>/([^<>\s]+)</command-name>", 1)
    arguments = stripped(F.regexp_extract(whole, r"(?s)<command-args>(.*?)</command-args>", 1))
    command = whole.rlike("^<command-(?:name|message)>") & (called != "")
    known = F.regexp_extract(whole, "<command-message>([^<>]+)</command-message>", 1) != ""
    echo = F.startswith(whole, F.lit(SKIPPED[0]))
    for head in SKIPPED[1:]:
        echo = echo | F.startswith(whole, F.lit(head))
    tagged = plain.isNotNull() & whole.rlike(r"(?s)^<\w+>.*</\w+>$")
    shown = F.when(command & (arguments != ""), arguments).when(command & known, F.concat(F.lit("/"), called)).when(echo | tagged, None).otherwise(whole)
    return F.nullif(shown, F.lit(""))


def _event(kind: str | Column, **values: Column) -> Column:
    given = {"type": F.lit(kind) if isinstance(kind, str) else kind} | values
    return F.struct(*[given.get(c, F.lit(None)).cast("string").alias(c) for c in COLUMNS]).cast(_EVENT)


def _lines(rows: DataFrame) -> DataFrame:
    """What each line is: its content, its error, what a human typed in it."""
    message = "$.message.content"
    kind = field("$.type")
    content = F.try_variant_get("v", message, "variant")
    listed = F.schema_of_variant(content).startswith("ARRAY")
    plain = F.when(F.schema_of_variant(content) == "STRING", field(message))
    lines = parsed(rows).filter(~flag("$.isSidechain") & ~flag("$.isMeta"))
    lines = lines.select("session", "pos", "v", kind.alias("kind"), plain.alias("plain"), F.when(listed, F.try_variant_get("v", message, _PART)).alias("parts"))
    flagged = (F.col("kind") == "assistant") & flag("$.isApiErrorMessage")
    stated = F.coalesce(*[F.nullif(stripped(field(f"$.error.{x}")), F.lit("")) for x in ("formatted", "message")])
    failure = F.when(flagged, F.coalesce(said_text(F.col("plain"), F.col("parts")), field("$.error"), F.lit("API request failed"))).when(F.col("kind") == "system", stated)
    origin = field("$.origin.kind")
    queued = (F.col("kind") == "attachment") & (field("$.attachment.type") == "queued_command") & (field("$.attachment.origin.kind").isin("human", "user") | flag("$.attachment.humanTurn"))
    prompt = F.nullif(stripped(field("$.attachment.prompt")), F.lit(""))
    typed = (
        F.when(queued & ~F.contains(F.substring(F.lower(prompt), 1, 200), F.lit("<task-notification")), prompt)
        .when((F.col("kind") == "user") & (origin.isNull() | (origin == "human")), said_text(F.col("plain"), F.col("parts")))
    )
    lines = lines.withColumns({"failure": failure, "origin": F.when(F.col("kind") == "attachment", "human").otherwise(origin), "typed": typed, "compact": flag("$.isCompactSummary")})
    lines = lines.withColumn("code", F.when(F.col("failure").isNotNull(), F.coalesce(*[F.nullif(stripped(field(p)), F.lit("")) for p in ("$.apiErrorStatus", "$.error.status")])))
    interrupted = F.coalesce(stripped(F.col("typed")).isin(*INTERRUPTED), F.lit(False))
    return lines.withColumns({"interrupted": interrupted, "typed": F.when(~interrupted, F.col("typed"))})


def events(rows: DataFrame) -> DataFrame:
    """The event log: ``session, seq`` and :data:`COLUMNS`, with ``error_kind, retryable`` of upstream errors.

    Upstream errors are collected: of several in a row the last counts, an
    assistant's text drops it, a human's text or the end of the session lets it
    come out, before that text.  Side chains and meta lines, lines that are no
    objects, and texts that are blank give no event.
    """
    lines = _lines(rows)
    answered = (F.col("kind") == "assistant") & F.col("failure").isNull() & F.exists("parts", lambda p: (p["type"] == "text") & (F.length(stripped(F.coalesce(p["text"], F.lit("")))) > 0))
    mark = F.when(F.col("failure").isNotNull(), F.struct(F.lit("error").alias("what"), "failure", "code")).when(F.coalesce(answered, F.lit(False)) | F.col("typed").isNotNull(), F.struct(F.lit("text").alias("what"), F.lit(None).cast("string").alias("failure"), F.lit(None).cast("string").alias("code")))
    lines = carry_forward(lines.withColumn("mark", mark), ["session"], "pos", F.col("mark"), "pending", strict=True)

    results = F.transform(
        F.filter("parts", lambda p: p["type"] == "tool_result"),
        lambda p: _event("tool_result", call_id=F.coalesce(p["tool_use_id"], F.lit("")), text=F.when(F.schema_of_variant(p["content"]) == "STRING", F.try_variant_get(p["content"], "$", "string")).otherwise(F.to_json(p["content"])), result_status=result_status(p["is_error"], p["content"])),
    )
    none = F.array().cast(f"array<{_EVENT}>")
    late = F.when(F.col("typed").isNotNull() & (F.col("pending.what") == "error"), F.array(_event("assistant_message", text=F.col("pending.failure"), error_code=F.coalesce("pending.code", F.lit(""))))).otherwise(none)
    injected = F.when(F.col("typed").isNull() & ~F.col("interrupted") & (F.col("kind") == "user") & (F.coalesce("origin", F.lit("human")) == "human") & (F.length(stripped(F.col("plain"))) > 0), F.array(_event("user_message", text=stripped(F.col("plain")), origin=F.lit("injected")))).otherwise(none)
    own = F.when(F.col("typed").isNotNull(), F.array(_event("user_message", text=F.col("typed"), origin=F.when(F.col("compact"), "system").otherwise(F.col("origin"))))).otherwise(none)
    message_id = F.nullif(stripped(field("$.message.id")), F.lit(""))
    spoken = F.filter(
        F.transform(
            F.filter("parts", lambda p: p["type"].isin("thinking", "text", "tool_use")),
            lambda p: F.when(p["type"] == "tool_use", _event("tool_call", name=F.coalesce(p["name"], F.lit("tool")), call_id=F.coalesce(p["id"], F.lit("")))).otherwise(
                _event(F.when(p["type"] == "thinking", "thinking").otherwise("assistant_message"), text=stripped(F.when(p["type"] == "thinking", F.coalesce(F.nullif(p["thinking"], F.lit("")), p["text"])).otherwise(p["text"])), message_id=message_id)
            ),
        ),
        lambda e: (e["type"] == "tool_call") | (F.length(e["text"]) > 0),
    )
    made = F.when(F.col("failure").isNotNull(), none).when(F.col("kind") == "user", F.concat(F.coalesce(results, none), late, own, injected)).when(F.col("kind") == "attachment", F.concat(late, own)).when(F.col("kind") == "assistant", F.coalesce(spoken, none)).otherwise(none)
    spread = lines.select("session", "pos", F.posexplode(made).alias("sub", "e"))
    left = lines.filter("mark IS NOT NULL").groupBy("session").agg(F.max_by("mark", "pos").alias("mark")).filter("mark.what = 'error'")
    left = left.select("session", F.lit(_LAST).alias("pos"), F.lit(0).alias("sub"), _event("assistant_message", text=F.col("mark.failure"), error_code=F.coalesce("mark.code", F.lit(""))).alias("e"))
    log = numbered_within(spread.unionByName(left).select("session", "pos", "sub", "e.*"), ["session"], "pos", "sub", "seq")
    judged = with_classification(log, F.lit("provider"), F.col("error_code"), F.col("text"))
    upstream = F.col("error_code").isNotNull()
    return judged.select("session", "seq", *COLUMNS[:-1], F.nullif("error_code", F.lit("")).alias("error_code"), F.when(upstream, F.col("error_kind")).alias("error_kind"), F.when(upstream, F.col("retryable")).alias("retryable"))


def cleaned(path: str) -> Column:
    """A native string field without white space at its ends; others are null."""
    return label(F.try_variant_get("v", path, "variant"))
