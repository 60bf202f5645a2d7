"""Text rules of session histories: errors, tools, titles, search and ids."""

from __future__ import annotations

import os.path
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of error classes, in the order in which the classes are tried.
REFUSALS = ("refus", "denied by user", "declined by user", "rejected by user", "not approved", "did not approve", "permission denied by user")
INTERRUPTS = ("interrupted by user", "request interrupted", "user interrupt", "cancelled by user", "canceled by user", "user cancelled", "user canceled", "turn_aborted", "messageabortederror", "operation was aborted", "operation aborted", "user_abort")
INTERRUPT_KINDS = ("aborted", "abort", "interrupt", "interrupted", "user_interrupt", "turn_aborted", "messageabortederror")
QUOTAS = ("usage_limit_exceeded", "usage limit", "quota", "session limit", "session_limit", "insufficient credits", "insufficient_quota", "credit balance", "credits exhausted", "weekly limit", "plan limit", "billing")
RATES = ("rate limit", "rate_limit", "rate-limited", "too many requests", "429")
AUTHS = ("providerautherror", "provider_auth", "unauthorized", "unauthenticated", "invalid api key", "invalid_api_key", "api key is invalid", "api_key_invalid", "authentication", "forbidden", "access denied")
CONTEXTS = ("context length", "context_length", "contextlimit", "maximum context", "max tokens", "max_tokens", "output length", "messageoutputlengtherror", "token limit", "tokens exceed", "too many tokens", "prompt too long")
OVERLOADS = ("overloaded", "overload", "capacity", "529", "server is busy")
POLICIES = ("policy_blocked", "blocked by policy", "blocked by content policy", "content policy", "policy violation", "violates policy", "guardrail", "safety system", "content_filter", "content filter")
TIMEOUTS = ("timed_out", "timed out", "timeout", "deadline exceeded", "deadline_exceeded", "etimedout", "request took too long")
RETRIES = ("retry attempt", "retry attempts", "after retries")
TOOLS = ("tool_error", "tool failed", "tool failure", "tool execution failed", "command failed", "exit code", "is_error", "permission denied", "eacces")
CRASHES = ("runtime_crash", "crashed", "segfault", "segmentation fault", "out of memory", "oom-killed", "process died", "was killed")
BAD_REQUESTS = ("bad_request", "invalid-request", "invalid_request", "invalid-output", "invalid_output", "invalid output")
PROVIDERS = ("internal error", "server error", "upstream error", "provider error", "connection", "econnreset", "etimedout", "timeout", "timed out", "stream ended", "temporarily unavailable", "bad gateway", "service unavailable", "certificate", "tls handshake", "ssl error")
RETRYABLE = {"rate_limited": True, "quota_exhausted": False, "auth": False, "context_length": False, "provider_overloaded": True, "provider_error": True, "policy_blocked": False, "tool_error": False, "user_interrupt": False, "timeout": True}

# Tool names by their kind.
TOOL_KINDS = {
    "read": ("read", "read_file", "readfile", "view", "view_file", "view_file_outline", "view_code_item"),
    "edit": ("edit", "edit_file", "replace_file_content", "multi_replace_file_content", "str_replace", "strreplace", "apply_patch", "multiedit", "notebookedit"),
    "write": ("write", "write_file", "write_to_file", "create_file"),
    "shell": ("bash", "shell", "exec", "exec_command", "run_command", "command_status", "send_command_input", "run_terminal_cmd", "local_shell"),
    "search": ("grep", "grep_search", "glob", "find_by_name", "list_dir", "list_directory", "search", "codebase_search", "search_code"),
    "web": ("websearch", "web_search", "search_web", "webfetch", "fetch", "read_url_content"),
    "task": ("task",), "skill": ("skill", "load_skill", "use_skill"), "todo": ("todowrite", "todo_write"),
    "question": ("askuserquestion", "askquestion", "ask_question", "request_user_input", "request_user_input_async", "question"),
}


def _holds(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether the text has a marker; an array keeps the expression small, however many there are."""
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def _codes(padded: Column, *codes: str) -> Column:
    return _holds(padded, tuple(f" {code} " for code in codes))


def _evidence(kind: Column, code: Column, message: Column) -> tuple[Column, Column]:
    """The kind alone and all evidence together, in lower case."""
    empty = F.lit("")
    return F.lower(F.trim(F.coalesce(kind, empty))), F.lower(F.concat_ws(" ", F.trim(F.coalesce(kind, empty)), F.trim(F.coalesce(code, empty)), F.coalesce(message, empty)))


_FINAL = "provider_error:final"
_MARKERS = (REFUSALS, INTERRUPTS, QUOTAS, RATES, AUTHS, CONTEXTS, OVERLOADS, POLICIES, TIMEOUTS, RETRIES, TOOLS, CRASHES, BAD_REQUESTS, PROVIDERS)
_CODES = ("400", "401", "403", "404", "422", "500", "502", "503", "504", "522", "524")


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words in which shared beginnings are tried once."""
    words = sorted(set(words))
    if "" in words:
        return ""  # a word ends here, so whatever follows matches too
    if len(words) == 1:
        return re.escape(words[0])
    shared = os.path.commonprefix(words)
    if shared:
        return re.escape(shared) + any_of(w[len(shared) :] for w in words)
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[0], []).append(word)
    if len(heads) > 6:  # a class of first letters tells most places apart at once
        half = len(heads) // 2
        sides = [list(heads)[:half], list(heads)[half:]]
        return "(?:" + "|".join(f"(?=[{''.join(side)}])" + any_of(w for head in side for w in heads[head]) for side in sides) + ")"
    return "(?:" + "|".join(any_of(group) for group in heads.values()) + ")"


#: Where this doesn't match, no rule on the text applies; letters of the last two may stand apart.
_ANY = "|".join([any_of([*(m for group in _MARKERS for m in group), *_CODES]), *("[_ -]*".join(word) for word in ("apierror", "providererror"))])


def _error_kind(raw: Column, text: Column) -> Column:
    padded, compact = F.concat(F.lit(" "), text, F.lit(" ")), F.translate(text, "_- ", "")
    rules = [
        (_holds(text, REFUSALS), "unknown"),
        (_holds(text, INTERRUPTS) | raw.isin(*INTERRUPT_KINDS), "user_interrupt"),
        (_holds(text, QUOTAS), "quota_exhausted"),
        (_holds(text, RATES), "rate_limited"),
        (_codes(padded, "401", "403") | _holds(text, AUTHS), "auth"),
        (_holds(text, CONTEXTS), "context_length"),
        (_holds(text, OVERLOADS), "provider_overloaded"),
        (_holds(text, POLICIES), "policy_blocked"),
        (_holds(text, TIMEOUTS), "timeout"),
        (_holds(text, RETRIES), _FINAL),
        (_holds(text, TOOLS), "tool_error"),
        (_holds(text, CRASHES), "runtime_crash"),
        (text.rlike(r"(?<![0-9])(?:400|404|422)(?![0-9])") | _holds(text, BAD_REQUESTS), _FINAL),
        (raw.isin("provider", "provider_error") | _holds(compact, ("apierror", "providererror")), "provider_error"),
        (_codes(padded, "500", "502", "503", "504", "522", "524"), "provider_error"),
        (_holds(text, PROVIDERS), "provider_error"),
    ]
    plain = F.when(raw.isin(*INTERRUPT_KINDS), "user_interrupt").when(raw.isin("provider", "provider_error"), "provider_error").otherwise("unknown")
    out = F.when(~text.rlike(_ANY), plain)
    for test, name in rules:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def _verdict(found: Column) -> Column:
    name = F.regexp_replace(found, ":final$", "")
    table = F.create_map(*[F.lit(x) for pair in RETRYABLE.items() for x in pair])
    return F.struct(name.alias("error_kind"), F.when(found == _FINAL, F.lit(False)).otherwise(F.try_element_at(table, name)).alias("retryable"))


def classify_error(kind: Column, code: Column, message: Column) -> Column:
    """``struct(error_kind, retryable)`` of native failure evidence; the order of the rules decides.

    For one field, or short messages; :func:`with_classification` goes over the evidence once.
    """
    return _verdict(_error_kind(*_evidence(kind, code, message)))


def with_classification(df: DataFrame, kind: Column, code: Column, message: Column, kept_kind: Column | None = None, kept_retryable: Column | None = None) -> DataFrame:
    """``df`` with ``error_kind, retryable``; what a record states itself (``kept_*``) is kept and only gaps are filled.

    The evidence is put together and put in lower case once for each row, and
    classified once.  Null evidence gives ``unknown`` and no ``retryable``.
    """
    raw, text = _evidence(kind, code, message)
    judged = df.withColumns({"__raw": raw, "__text": text}).withColumn("__found", _error_kind(F.col("__raw"), F.col("__text")))
    verdict = _verdict(F.col("__found"))
    name = verdict["error_kind"] if kept_kind is None else F.coalesce(kept_kind, verdict["error_kind"])
    again = verdict["retryable"] if kept_retryable is None else F.coalesce(kept_retryable, verdict["retryable"])
    return judged.withColumns({"error_kind": name, "retryable": again}).drop("__raw", "__text", "__found")


def http_status(text: Column) -> Column:
    """The first number from 100 to 599 that stands alone."""
    return F.nullif(F.regexp_extract(text, "(?<![0-9])([1-5][0-9]{2})(?![0-9])", 1), F.lit("")).cast("int")


def tool_kind(name: Column) -> Column:
    """The kind of a tool by its name, whatever the case; ``other`` if unknown."""
    table = F.create_map(*[F.lit(x) for kind, names in TOOL_KINDS.items() for name in names for x in (name, kind)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit("other"))


def completion_id(status: Column, anchor: Column, tail: Column) -> Column:
    """A stable id of a finished round; empty unless it is done or aborted and has an anchor."""
    digest = F.substring(F.sha2(F.concat(anchor, F.lit("\n"), F.substring(F.coalesce(tail, F.lit("")), 1, 500)), 256), 1, 16)
    return F.when(status.isin("done", "aborted") & (F.length(anchor) > 0), F.concat(status, F.lit(":"), digest)).otherwise(F.lit(""))


def first_line(text: Column) -> Column:
    """The first line that isn't blank and isn't a bare URL, without quote marks at its head and with single blanks."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[>\s]+", ""), r"\s+", " ")))
    return F.get(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^https?://\S+$")), 0)


def excerpt(text: Column, size: int = 120) -> Column:
    """At most ``size`` characters, the last an ellipsis if more were there."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


#: Search weights of the fields of a session.
WEIGHTS = {"title": 100, "fallback_title": 80, "first_user_msg": 60, "last_user_msg": 60, "last_agent_msg": 35, "cwd": 20, "cwd_display": 20}


def match_score(fields: dict[str, Column], keywords: list[str]) -> Column:
    """Sum of each field's weight times the keywords it holds."""
    total = F.lit(0)
    for name, value in fields.items():
        for word in keywords:
            hit = F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit(word.lower()))
            total = total + F.when(hit, F.lit(WEIGHTS[name])).otherwise(F.lit(0))
    return total


def snippet(text: Column, keyword: str, before: int = 40, after: int = 80) -> Column:
    """The surroundings of the first hit, trimmed; null without a hit."""
    at = F.instr(F.lower(text), keyword.lower())
    begin = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.trim(F.substring(text, begin, at - begin + len(keyword) + after)))


def short_folder(path: Column, home: str) -> Column:
    """A folder below ``home`` with ``~`` for it."""
    return F.when(F.startswith(path, F.lit(home)), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


def decode_percent(text: Column) -> Column:
    """Percent escapes decoded; a plus stays a plus."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def file_path(uri: Column) -> Column:
    """The path of a ``file://`` address; other texts are themselves."""
    return F.when(F.startswith(uri, F.lit("file://")), decode_percent(F.substring(uri, 8, 1 << 30))).otherwise(uri)


def message_time(seconds: Column) -> Column:
    """Month, day, hour and minute in the session's time zone; null stays null."""
    return F.date_format(F.timestamp_seconds(seconds), "MM-dd HH:mm")


def iso_seconds(text: Column) -> Column:
    """Seconds since the epoch of an ISO time; without a zone it is local time, anything else is null."""
    return F.unix_micros(F.try_to_timestamp(F.trim(text))) / 1e6


def coerced_arguments(text: Column) -> Column:
    """Arguments of a call as VARIANT: null is an empty object, JSON is read, other text stays a string."""
    return F.coalesce(F.try_parse_json(F.coalesce(text, F.lit("{}"))), F.try_variant_get(F.parse_json(F.to_json(F.struct(text.alias("t")))), "$.t", "variant"))


def performance_id(session: Column, runtime: Column, record: Column, kind: Column) -> Column:
    """``session|runtime:record:kind``."""
    return F.concat(session, F.lit("|"), F.concat_ws(":", runtime, record, kind))
