"""How sessions end: outcomes and list tags of two dialects, by automata over their lines.

Each line gives at most one symbol; :mod:`loglattice.operators.automaton` finds the
state in which a session ends and the line that set it.  Calls without a result are a
grouping by id, from the last line on that closes a turn.  ``rows`` has ``session, pos,
raw``; a null session is a session, lines that are no objects say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.guards import stripped
from loglattice.operators.automaton import Automaton, run
from loglattice.operators.ordered import bound, meet
from loglattice.sources.blobs import _at, _is, _string
from loglattice.sources.claude import INTERRUPTED, field, flag, parsed, said_text
from loglattice.sources.shared import settle

# The beginning of an agent's text about a used-up limit, beginnings of context, and a skill's fragment.
LIMIT = "You've hit your session limit"
CONTEXT = ("# AGENTS.md instructions", "<environment_context>")
SKILL = r"\A\s*(?:<skill>\s*<name>[^<>\r\n]+</name>\s*<path>[^<>\r\n]+</path>[\s\S]*?</skill>\s*)+\z"
#: Tags of a list.
TAGS = {"aborted": "⚠️已中断", "pending": "⏳待回复", "done": "✅已完成", "none": ""}

_PART = "array<struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,content:variant,is_error:variant>>"
_MARKED = ("error", "interrupted", "pending", "agent", "none")

#: Ends of message lines.  Whether the agent's last text was about a limit is part of the state, since a call without text keeps it.
MESSAGES = Automaton(
    ("none", *[f"{s}{more}" for more in ("", "+limit") for s in _MARKED if f"{s}{more}" != "none"]),
    {"said": "agent", "limit": "agent+limit"},
    {symbol: {f"{s}{more}": f"{to}{more}" for s in _MARKED for more in ("", "+limit")} for symbol, to in (("failed", "error"), ("interrupt", "interrupted"), ("typed", "pending"), ("called", "agent"))},
)
#: Tags of message lines: an ended text counts as done only until the turn goes on.
MESSAGE_TAGS = Automaton(
    ("none", "error", "interrupted", "pending", "limit", "done", "progress"),
    {"failed": "error", "interrupt": "interrupted", "typed": "pending", "limit": "limit", "said_end": "done", "said_more": "progress"},
    {"other": {"done": "progress"}},
)
#: Ends of items: work after a closed turn opens it again.
ITEMS = Automaton(
    ("none", "user", "agent", "complete", "failed", "aborted", "working"),
    {"user": "user", "agent": "agent", "complete": "complete", "failed": "failed", "aborted": "aborted"},
    {"tool": {"complete": "working", "failed": "working", "aborted": "working"}},
)
_CLOSING = ("user", "complete", "failed", "aborted")


def _unanswered(marks: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """``session, open`` of the sessions with calls that have no result; only what lies after ``since(session, closed)`` counts."""
    ids = marks.select("session", "pos", F.explode(F.concat(F.transform("issued", lambda i: F.struct(i.alias("id"), F.lit(True).alias("call"))), F.transform("answered", lambda i: F.struct(i.alias("id"), F.lit(False).alias("call"))))).alias("x"))
    if since is not None:
        ids = meet(ids, since, ["session"], "left").filter(F.col("closed").isNull() | (F.col("pos") > F.col("closed")))
    each = ids.groupBy("session", "x.id").agg(F.bool_and("x.call").alias("open"))
    return each.filter("open").groupBy("session").agg(F.lit(True).alias("open"))


def _found(ended: DataFrame, marks: DataFrame, columns: list[str]) -> DataFrame:
    """The ended sessions with ``columns`` of the line that set their state."""
    lines = marks.filter("symbol is not null").select("session", F.col("pos").alias("at"), *columns).dropDuplicates(["session", "at"])
    return meet(ended, lines, ["session", "at"], "left")


def message_marks(rows: DataFrame) -> DataFrame:
    """What each message line says of its session's end: ``symbol``, ``tag`` (for lists), ``text``, ``code`` and the ids of calls and results."""
    content = F.try_variant_get("v", "$.message.content", "variant")
    held = parsed(rows).select("session", "pos", "v", field("$.type").alias("kind"), F.when(F.schema_of_variant(content) == "STRING", field("$.message.content")).alias("plain"), F.when(_is(content, "ARRAY"), F.try_variant_get(content, "$", _PART)).alias("parts"))
    aside = flag("$.isMeta") | flag("$.isSidechain")
    stated = F.coalesce(*[F.nullif(stripped(field(f"$.error.{x}")), F.lit("")) for x in ("formatted", "message")])
    told = F.coalesce(said_text(F.col("plain"), F.col("parts")), field("$.error"), F.lit("API request failed"))
    failure = F.when((F.col("kind") == "assistant") & flag("$.isApiErrorMessage"), told).when(F.col("kind") == "system", stated)
    code = F.coalesce(*[F.nullif(stripped(field(p)), F.lit("")) for p in ("$.apiErrorStatus", "$.error.status")])
    queued = (F.col("kind") == "attachment") & (field("$.attachment.type") == "queued_command") & (field("$.attachment.origin.kind").isin("human", "user") | flag("$.attachment.humanTurn"))
    typed = F.when(queued, F.nullif(stripped(field("$.attachment.prompt")), F.lit(""))).when((F.col("kind") == "user") & ~aside, said_text(F.col("plain"), F.col("parts")))
    first = F.array_position(F.transform("parts", lambda p: (p["type"] == "text") & (F.length(stripped(F.coalesce(p["text"], F.lit("")))) > 0)), True)
    stop = F.try_variant_get("v", "$.message.stop_reason", "variant")
    ended = stop.isNull() | F.coalesce(_string(stop) == "end_turn", F.lit(False))
    held = held.withColumns({"aside": aside, "failure": failure, "code": code, "typed": typed, "ended": ended, "first": F.when(F.col("kind") == "assistant", first)}).drop("v", "plain")
    held = bound(held)
    said = F.when(F.col("first") > 0, F.get("parts", (F.col("first") - 1).cast("int"))["text"])
    before = F.when(F.col("first") > 0, F.slice("parts", F.lit(1), (F.col("first") - 1).cast("int"))).otherwise(F.col("parts"))
    ids = lambda parts, kind, name: F.filter(F.transform(F.filter(parts, lambda p: p["type"] == kind), lambda p: p[name]), lambda i: i != "")
    none = F.array().cast("array<string>")
    held = held.withColumns({
        "said": said,
        "issued": F.when((F.col("kind") == "assistant") & ~F.col("aside") & F.col("failure").isNull(), F.coalesce(ids(before, "tool_use", "id"), none)).otherwise(none),
        "answered": F.when((F.col("kind") == "user") & ~F.col("aside"), F.coalesce(ids(F.col("parts"), "tool_result", "tool_use_id"), none)).otherwise(none),
    })
    held = bound(held.drop("parts"))
    interrupted = F.coalesce(stripped(F.col("typed")).isin(*INTERRUPTED), F.lit(False))
    limit = F.startswith("said", F.lit(LIMIT))
    common = F.when(F.col("failure").isNotNull(), "failed").when(interrupted, "interrupt").when(F.col("typed").isNotNull(), "typed").when(limit, "limit")
    symbol = F.when(~F.col("aside"), common.when(F.col("said").isNotNull(), "said").when(F.size("issued") > 0, "called"))
    tag = common.when(F.col("said").isNotNull(), F.when(F.col("ended"), "said_end").otherwise("said_more")).when(F.col("kind").isin("assistant", "user"), "other")
    return held.select("session", "pos", symbol.alias("symbol"), tag.alias("tag"), F.coalesce("failure", F.when(interrupted, INTERRUPTED[0]), "said").alias("text"), F.when(F.col("failure").isNotNull(), F.col("code")).alias("code"), "issued", "answered")


def message_outcomes(rows: DataFrame) -> DataFrame:
    """``session, status, at, error_kind, error, code``: how message sessions end, and the line it rests on."""
    marks = settle(message_marks(rows), "message-marks")
    ended = _found(run(marks, MESSAGES, seq="pos"), marks, ["text", "code"])
    ended = meet(ended, _unanswered(marks), ["session"], "left")
    limited = F.col("state") == "agent+limit"
    state = F.regexp_replace("state", r"\+limit$", "")
    status = F.when(state.isin("error", "interrupted") | limited, "aborted").when(state == "pending", "pending").when((state == "agent") & F.col("open").isNull(), "done").otherwise("unknown")
    kind = F.when((state == "error") | limited, "provider").when(state == "interrupted", "aborted")
    return ended.select("session", status.alias("status"), "at", kind.alias("error_kind"), F.when(kind.isNotNull(), F.col("text")).alias("error"), F.when(state == "error", F.col("code")).alias("code"))


def message_tags(rows: DataFrame) -> DataFrame:
    """``session, tag, at``: the status of message sessions in a list; a text counts as an end only by a native stop and if nothing follows."""
    marks = settle(message_marks(rows).select("session", "pos", "tag"), "message-tags")
    ended = run(marks, MESSAGE_TAGS, seq="pos", symbol="tag")
    kind = F.when(F.col("state").isin("error", "interrupted", "limit"), "aborted").when(F.col("state").isin("pending", "done"), F.col("state")).otherwise("none")
    table = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return ended.select("session", F.element_at(table, kind).alias("tag"), "at")


def _item_text(role: str) -> Column:
    """The text of an item of one role, context left out."""
    content = F.when(_is(field("$.payload.content", "variant"), "ARRAY"), field("$.payload.content", "array<variant>"))
    pieces = F.transform(F.filter(content, lambda p: _at(p, "$.type").isin("input_text", "output_text")), lambda p: stripped(F.coalesce(_at(p, "$.text"), F.lit(""))))
    text = F.array_join(F.filter(pieces, lambda t: t != ""), "\n")
    context = F.startswith(text, F.lit(CONTEXT[0])) | F.startswith(text, F.lit(CONTEXT[1])) | (text.rlike(SKILL) if role == "user" else F.lit(False))
    return F.when((field("$.payload.type") == "message") & (field("$.payload.role") == role) & ~context, F.nullif(text, F.lit("")))


def item_marks(rows: DataFrame) -> DataFrame:
    """What each item line says of its session's end: ``symbol, text, code`` and the ids of calls and results."""
    kind, inner = field("$.type"), field("$.payload.type")
    note = lambda name: F.when((kind == "event_msg") & (inner == name), F.nullif(stripped(field("$.payload.message")), F.lit("")))
    user = F.coalesce(F.when(~note("user_message").rlike(SKILL), note("user_message")), F.when(kind == "response_item", _item_text("user")))
    agent = F.coalesce(note("agent_message"), F.when(kind == "response_item", _item_text("assistant")))
    error = field("$.payload.error", "variant")
    failure = F.nullif(stripped(F.when(_is(error, "OBJECT"), F.coalesce(F.nullif(_at(error, "$.message"), F.lit("")), _at(error, "$.codex_error_info"))).otherwise(_string(error))), F.lit(""))
    call, result = inner.isin("function_call", "custom_tool_call"), inner.isin("function_call_output", "custom_tool_call_output")
    done = (kind == "event_msg") & (inner == "task_complete")
    symbol = (
        F.when(user.isNotNull(), "user").when(call | result, "tool").when(agent.isNotNull(), "agent").when(done & failure.isNotNull(), "failed").when(done, "complete").when((kind == "event_msg") & (inner == "turn_aborted"), "aborted")
    )
    none = F.array().cast("array<string>")
    call_id = F.coalesce(F.nullif(field("$.payload.call_id"), F.lit("")), F.when(call, F.nullif(field("$.payload.id"), F.lit(""))))
    held = parsed(rows).filter(_is(field("$.payload", "variant"), "OBJECT"))
    ids = lambda on: F.when(on & call_id.isNotNull(), F.array(call_id)).otherwise(none)
    return held.select("session", "pos", symbol.alias("symbol"), failure.alias("text"), F.nullif(stripped(_at(error, "$.codex_error_info")), F.lit("")).alias("code"), ids(call).alias("issued"), ids(result).alias("answered"))


def item_outcomes(rows: DataFrame) -> DataFrame:
    """``session, status, at, error_kind, error, code``: how item sessions end, and the line it rests on."""
    marks = settle(item_marks(rows), "item-marks")
    ended = _found(run(marks, ITEMS, seq="pos"), marks, ["text", "code"])
    closed = marks.filter(F.col("symbol").isin(*_CLOSING)).groupBy("session").agg(F.max("pos").alias("closed"))
    ended = meet(ended, _unanswered(marks, closed), ["session"], "left")
    state, clean = F.col("state"), F.col("open").isNull()
    status = F.when(state.isin("aborted", "failed"), "aborted").when(state == "complete", "done").when((state == "user") & clean, "pending").when((state == "agent") & clean, "done").otherwise("unknown")
    kind = F.when(state == "aborted", "aborted").when(state == "failed", "provider")
    return ended.select("session", status.alias("status"), "at", kind.alias("error_kind"), F.when(state == "aborted", "turn_aborted").when(state == "failed", F.col("text")).alias("error"), F.when(state == "failed", F.col("code")).alias("code"))
