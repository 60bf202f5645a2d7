"""Automata in buckets against walks, and how sessions end."""

import json
import random

import pytest

from loglattice.operators.automaton import Automaton, run
from loglattice.sources import outcomes

MACHINES = [outcomes.MESSAGES, outcomes.MESSAGE_TAGS, outcomes.ITEMS, Automaton(("a", "b", "c"), {"reset": "a"}, {"next": {"a": "b", "b": "c", "c": "a"}, "back": {"b": "a"}})]


def walk(machine, symbols):
    state, at = machine.states[0], None
    for seq, symbol in symbols:
        to = machine.target(symbol, state) if symbol in machine.symbols() else None
        if to is not None:
            state, at = to, seq
    return state, at


@pytest.mark.parametrize("machine", MACHINES)
@pytest.mark.parametrize(("bucket", "fan"), [(1 << 12, 256), (5, 2), (1, 3)])
def test_any_grouping_gives_the_walk(spark, machine, bucket, fan):
    rng = random.Random(4)
    sessions = {s: [(k * 2 - 30, rng.choice([*machine.symbols(), None, "?"])) for k in range(n)] for s, n in (("a", 90), ("b", 7), (None, 40), ("still", 1))}
    sessions["still"] = [(5, None)]
    rows = spark.createDataFrame([(s, *r) for s, x in sessions.items() for r in x], "session string, seq long, symbol string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in run(rows, machine, bucket=bucket, fan=fan).collect()}
    assert got == {s: walk(machine, x) for s, x in sessions.items()}
    assert run(rows.limit(0), machine).count() == 0


def assistant(*parts, **message):
    return {"type": "assistant", "message": {"content": list(parts), **message}}


def text(x):
    return {"type": "text", "text": x}


CALL, OTHER = {"type": "tool_use", "id": "c1"}, {"type": "tool_use", "id": "c2"}
ANSWER = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1"}]}}
TYPED = {"type": "user", "message": {"content": "do it"}}
FAILED = {"type": "system", "error": {"message": " gone ", "status": "504"}}
FLAGGED = {"type": "assistant", "isApiErrorMessage": True, "apiErrorStatus": "429", "message": {"content": [text("slow down")]}}
LIMITED = assistant(text("You've hit your session limit now"))
MESSAGE_CASES = {
    "nothing": ([{"type": "system"}], ("unknown", None), ""),
    "asked": ([assistant(text("x")), TYPED], ("pending", None), "⏳待回复"),
    "said": ([TYPED, assistant(text("x"))], ("done", None), "✅已完成"),
    "ended": ([TYPED, assistant(text("x"), stop_reason="end_turn"), {"type": "attachment", "attachment": {"type": "date"}}], ("done", None), "✅已完成"),
    "cut off": ([TYPED, assistant(text("x"), stop_reason="max_tokens")], ("done", None), ""),
    "null stop": ([TYPED, assistant(text("x"), stop_reason=None)], ("done", None), ""),
    "open call": ([TYPED, assistant(CALL)], ("unknown", None), "⏳待回复"),
    "answered": ([TYPED, assistant(CALL, text("x")), ANSWER], ("done", None), ""),
    "calls after text don't count": ([TYPED, assistant(text("x"), OTHER)], ("done", None), "✅已完成"),
    "failed": ([TYPED, assistant(text("x")), FAILED], ("aborted", "provider"), "⚠️已中断"),
    "flagged": ([TYPED, FLAGGED], ("aborted", "provider"), "⚠️已中断"),
    "recovered": ([FAILED, assistant(text("x"))], ("done", None), "✅已完成"),
    "interrupted": ([assistant(text("x")), {"type": "user", "message": {"content": "[Request interrupted by user]"}}], ("aborted", "aborted"), "⚠️已中断"),
    "limit": ([TYPED, LIMITED], ("aborted", "provider"), "⚠️已中断"),
    "limit, then a call": ([LIMITED, assistant(CALL), ANSWER], ("aborted", "provider"), "⚠️已中断"),
    "aside": ([assistant(text("x")), {**TYPED, "isMeta": True}], ("done", None), ""),
}


def test_message_endings(spark):
    rows = [(name, k, json.dumps(line)) for name, (lines, *_) in MESSAGE_CASES.items() for k, line in enumerate(lines)]
    df = spark.createDataFrame([*rows, ("broken", 0, "{"), (None, 1, json.dumps(TYPED))], "session string, pos long, raw string")
    found = {r["session"]: r for r in outcomes.message_outcomes(df).collect()}
    assert {k: (found[k]["status"], found[k]["error_kind"]) for k in MESSAGE_CASES} == {k: v[1] for k, v in MESSAGE_CASES.items()}
    assert found[None]["status"] == "pending" and (found["failed"]["error"], found["failed"]["code"], found["failed"]["at"]) == ("gone", "504", 2) and found["flagged"]["code"] == "429"
    tags = {r["session"]: r["tag"] for r in outcomes.message_tags(df).collect()}
    assert {k: tags[k] for k in MESSAGE_CASES} == {k: v[2] for k, v in MESSAGE_CASES.items()}


def item(kind, **payload):
    return {"type": "event_msg" if kind in ("user_message", "agent_message", "task_complete", "turn_aborted") else "response_item", "payload": {"type": kind, **payload}}


ASK, SAY, RUN, RAN = item("user_message", message="do"), item("agent_message", message="did"), item("function_call", call_id="c1"), item("function_call_output", call_id="c1")
SKILL = "<skill> <name>a</name> <path>/p</path> text </skill>"
ITEM_CASES = {
    "asked": ([SAY, ASK], ("pending", None)),
    "context": ([SAY, item("message", role="user", content=[{"type": "input_text", "text": "<environment_context>"}]), item("user_message", message=SKILL)], ("done", None)),
    "said": ([ASK, RUN, RAN, SAY], ("done", None)),
    "open": ([ASK, RUN, SAY], ("unknown", None)),
    "asked again": ([ASK, RUN, ASK], ("pending", None)),
    "complete": ([ASK, RUN, item("task_complete")], ("done", None)),
    "goes on": ([ASK, item("task_complete"), RUN, RAN], ("unknown", None)),
    "spoken later": ([ASK, RUN, item("task_complete"), SAY], ("done", None)),
    "failed": ([ASK, item("task_complete", error={"message": " bad ", "codex_error_info": "quota"})], ("aborted", "provider")),
    "aborted": ([ASK, item("turn_aborted")], ("aborted", "aborted")),
    "nothing": ([item("reasoning")], ("unknown", None)),
}


def test_item_endings(spark):
    rows = [(name, k, json.dumps(line)) for name, (lines, _) in ITEM_CASES.items() for k, line in enumerate(lines)]
    found = {r["session"]: r for r in outcomes.item_outcomes(spark.createDataFrame(rows, "session string, pos long, raw string")).collect()}
    assert {k: (r["status"], r["error_kind"]) for k, r in found.items()} == {k: v[1] for k, v in ITEM_CASES.items()}
    assert (found["failed"]["error"], found["failed"]["code"], found["aborted"]["error"]) == ("bad", "quota", "turn_aborted")
