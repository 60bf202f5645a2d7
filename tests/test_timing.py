"""Durations of turns and phases, and time covered by two sets of intervals."""

import json
import random

from loglattice.operators import intervals
from loglattice.sources import timing


def lines(spark, rows):
    return spark.createDataFrame([(s, k, json.dumps(x) if not isinstance(x, str) else x) for s, xs in rows.items() for k, x in enumerate(xs)], "session string, pos long, raw string")


def usage(turn, output=None, **more):
    return {"type": "token_usage_record", "payload": {"turn_id": turn, **({"turn_token_usage": {"output_tokens": output}} if output is not None else {}), **more}}


def done(turn="t", kind="task_complete", **more):
    return {"type": "event_msg", "payload": {"type": kind, "turn_id": turn, **more}}


def test_item_turns(spark):
    context = {"type": "turn_context", "payload": {"turnId": " t ", "model": "asked"}}
    rows = {
        "plain": [context, usage("t", 5, model="used", response_id="r1"), usage("t", 50, response_id="r2"), usage("t", True), usage("t", 1.5), done(duration_ms=500, started_at=3, completed_at=0, time_to_first_token_ms=20)],
        "context": [context, {**context, "payload": {"turn_id": "t", "model": "later"}}, usage("t", 3.0), done(duration_ms=1000)],
        "aborted": [usage("t", 5), done(kind="turn_aborted", duration_ms=5)], "failed": [usage("t", 5), done(duration_ms=5, error={"message": "x"}, time_to_first_token_ms=-1)],
        "no output": [done(duration_ms=5)], "no turn": [usage(None, 5), done(turn=None, duration_ms="5")], "zero": [usage("t", 5), done(duration_ms=0, error="")], "other turn": [usage("u", 5), done(duration_ms=True)], "noise": ["[1]", "{", {"type": "event_msg"}],
    }
    got = {(r["session"], r["kind"]): r for r in timing.item_turns(lines(spark, rows)).collect()}
    turn = {k[0]: (r["duration_ms"], r["output_tokens"], r["allow_rate"], r["tokens_per_second"], r["model"], r["diagnostics"]) for k, r in got.items() if k[1] == "turn_elapsed"}
    assert turn == {
        "plain": (500.0, 50, True, 100.0, "used", ""), "context": (1000.0, 3, True, 3.0, "asked", ""), "aborted": (5.0, 5, False, None, None, "turn_aborted_no_rate:line:1"), "failed": (5.0, 5, False, None, None, "error_bearing_no_rate:line:1"),
        "no output": (5.0, None, False, None, None, "missing_turn_output:line:0"), "no turn": (None, None, False, None, None, "unusable_duration_ms:line:1,missing_turn_id:line:1,unlinked_turn_output:line:1"),
        "zero": (0.0, 5, False, None, None, "nonpositive_duration_no_rate:line:1"), "other turn": (None, None, False, None, None, "unusable_duration_ms:line:1,missing_turn_output:line:1"),
    }
    assert (got["plain", "turn_elapsed"]["started_at"], got["plain", "turn_elapsed"]["ended_at"], got["plain", "turn_elapsed"]["responses"]) == (3.0, None, 2)
    first = {k[0]: (r["duration_ms"], r["diagnostics"]) for k, r in got.items() if k[1] == "first_output_latency"}
    assert first == {"plain": (20.0, ""), "failed": (None, "unusable_first_output_latency:line:1")}


def test_message_phases(spark):
    def data(created=10, streamed=30, completed=110, output=5, **more):
        times = {k: v for k, v in (("created", created), ("streamed", streamed), ("completed", completed)) if v is not None}
        return {"role": "assistant", "finish": "stop", "time": times, "tokens": {"output": output}, **more}

    rows = {
        "good": data(model={"id": " m "}, native={"responseId": "r"}), "error": data(error={"x": 1}), "retry": data(retry={}), "running": data(completed=None, finish=None), "null retry": data(retry=None), "no tokens": data(output="5"),
        "backwards": data(completed=9, modelID="n"), "at once": data(completed=10), "no times": data(None, None, None), "no start": data(created=True), "user": {**data(), "role": "user"},
    }
    messages = spark.createDataFrame([("s", k, json.dumps(v)) for k, v in rows.items()] + [("s", "broken", "{")], "session string, id string, data string")
    got = timing.message_phases(messages).collect()
    step = {r["id"]: (r["duration_ms"], r["tokens_per_second"], r["diagnostics"]) for r in got if r["kind"] == "step_elapsed"}
    assert step == {
        "good": (100.0, 50.0, ""), "error": (100.0, None, "error_present_no_rate"), "retry": (100.0, None, "retry_present_no_rate"), "running": (None, None, "missing_timing_no_rate"), "null retry": (100.0, 50.0, ""), "no tokens": (100.0, None, "missing_output_tokens_no_rate"),
        "backwards": (None, None, "invalid_duration_no_rate"), "at once": (0.0, None, "nonpositive_duration_no_rate"), "no start": (None, None, "missing_timing_no_rate"),
    }
    provider = {r["id"]: r["diagnostics"] for r in got if r["kind"] == "provider_phase_elapsed"}
    assert provider["running"] == "finish_not_terminal_no_rate" and provider["good"] == "" and len(provider) == len(step)
    assert {r["kind"] for r in timing.message_phases(messages, streamed=False).collect()} == {"step_elapsed"}
    named = {r["id"]: (r["model"], r["response_id"]) for r in got}
    assert named["good"] == ("m", "r") and named["backwards"] == ("n", None)


def test_overlap(spark):
    rng = random.Random(2)
    sets = [[(rng.choice(["a", "b", None]), x := rng.randrange(400), x + rng.randrange(-2, 30)) for _ in range(60)] for _ in range(2)]
    frames = [spark.createDataFrame(x, "k string, a long, b long").repartition(3) for x in sets]
    covered = lambda rows, k: {t for s, a, b in rows if s == k for t in range(a, b)}
    want = {}
    for k in ("a", "b", None):
        p, q = covered(sets[0], k), covered(sets[1], k)
        want[k] = tuple(len(x) / 1e6 for x in (p & q, p - q, q - p))
    for bucket in (7, 50, 10_000):
        assert {r[0]: tuple(r[1:]) for r in intervals.overlap(*frames, ["k"], bucket).collect()} == want
    assert intervals.overlap(frames[0].limit(0), frames[1].limit(0), ["k"]).count() == 0
