"""Native lines to events, and streams to change logs."""

import json

from pyspark.sql import functions as F

from loglattice.operators import relations
from loglattice.sources import claude, collect, interpret, jsonl
from loglattice.streaming import changelog


def put(folder, name, lines, end="\n"):
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + end)


def test_lines_keep_their_numbers(spark, tmp_path):
    put(tmp_path, "a.jsonl", [{"k": 1}, "", "{broken", "[1]", {"k": 2}, '{"partial'], end="")
    got = sorted((r["pos"], r["state"]) for r in jsonl.read_lines(spark, str(tmp_path)).collect())
    assert got == [(1, "ok"), (3, "malformed"), (4, "non_object"), (5, "ok")]
    (tmp_path / "rollout-2024-01-01-0123abcd-0000-1111-2222-0123456789ab.jsonl").write_text("{}\n")
    assert {r["id"] for r in jsonl.discover(spark, str(tmp_path)).collect()} == {"a", "0123abcd-0000-1111-2222-0123456789ab"}


def rows(spark, folder, lines):
    put(folder, "s.jsonl", lines)
    return jsonl.read_lines(spark, str(folder)).filter("state = 'ok'").select(F.lit("s").alias("session"), "pos", "raw")


def kinds(df):
    return [(r["type"], r["text"]) for r in df.orderBy("seq").collect()]


def test_tree_of_messages(spark, tmp_path):
    say = lambda role, text: {"role": role, "content": text}
    df = rows(spark, tmp_path, [
        {"type": "session", "id": "x"}, {"type": "message", "id": "1", "parentId": None, "message": say("user", "hi")}, {"type": "message", "id": "2", "parentId": "1", "message": say("assistant", "dropped")},
        {"type": "message", "id": "3", "parentId": "1", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yes"}, {"type": "toolCall", "id": "c", "name": "bash"}]}},
        {"type": "message", "id": "4", "parentId": "3", "message": {"role": "toolResult", "toolCallId": "c", "content": "out"}},
    ])
    assert kinds(interpret.pi_events(df)) == [("user_message", "hi"), ("thinking", "hm"), ("assistant_message", "yes"), ("tool_call", "bash"), ("tool_result", "out")]


def test_flat_items_with_sticky_turns(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "payload": p}
    df = rows(spark, tmp_path, [
        {"type": "turn_context", "payload": {"turn_id": "t1"}}, item(type="message", role="user", content=[{"type": "input_text", "text": "go"}]), {"type": "event_msg", "payload": {"type": "user_message", "message": "go"}},
        item(type="function_call", call_id="c", name="shell"), item(type="function_call_output", call_id="c", output="done"), {"type": "event_msg", "payload": {"type": "task_complete", "turn_id": "t1"}},
    ])
    out = interpret.codex_events(df)
    assert kinds(out) == [("user_message", "go"), ("tool_call", "shell"), ("tool_result", "done"), ("lifecycle", "task_complete")]
    assert {r["turn_id"] for r in out.collect()} == {"t1"}


def test_loop_parts_are_merged(spark, tmp_path):
    part = lambda kind, text: {"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": kind, "text": text}}}
    df = rows(spark, tmp_path, [{"type": "context.append_message", "message": {"role": "user", "content": [{"type": "text", "text": "q"}]}}, part("text", "a"), part("text", "b"), {"type": "turn.ended", "reason": "completed"}])
    events = interpret.kimi_events(df)
    assert [r["text"] for r in interpret.merged_assistant(events).orderBy("seq").collect()] == ["q", "a\n\nb"]


def test_session_windows_of_a_stream_equal_the_batch(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/events.parquet")
    batch = {tuple(r) for r in changelog.session_activity(table, gap="1 hour").collect()}
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    last = table.select(F.max("ts").cast("timestamp")).first()[0]
    stream = changelog.session_activity(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), gap="1 hour")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("sessions").collect()}
    assert got <= batch and {r for r in batch if (last - r[2]).total_seconds() > 7200} <= got


def test_changelog_survives_delivery_twice(spark, tmp_path):
    schema = "session string, key string, generation long, pos long, op string, text string"
    source = tmp_path / "in"
    spark.createDataFrame([("s", "a", 1, 1, "upsert", "x"), ("s", "a", 1, 2, "upsert", "y"), ("s", "b", 1, 3, "upsert", "z")], schema).coalesce(1).write.parquet(str(source))
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(str(source))
        changelog.changelog(stream, str(tmp_path / "out"), str(tmp_path / f"at{k}")).trigger(availableNow=True).start().awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["key"], r["text"]) for r in changelog.state_of(log).collect()) == [("a", "y"), ("b", "z")]
    assert log.count() == 2


def test_appends_continue_the_latest_base(spark):
    schema = "session string, key string, generation long, pos long, op string, text string"
    df = spark.createDataFrame([("s", "a", 1, 1, "upsert", "old"), ("s", "a", 1, 2, "upsert", "ne"), ("s", "a", 1, 3, "append", "w"), ("s", "b", 1, 4, "append", "?")], schema)
    assert sorted((r["key"], r["text"], r["gap"]) for r in changelog.appended(df).collect()) == [("a", "new", False), ("b", "?", True)]


def test_a_line_of_many_parts_and_a_long_branch(spark, tmp_path):
    """5,000 parts in one line keep their numbers apart from the next line's; a branch of 5,000 entries keeps its oldest."""
    parts = [{"type": "text", "text": f"p{k}"} for k in range(5000)]
    df = rows(spark, tmp_path, [{"type": "message", "id": "1", "message": {"role": "assistant", "content": parts}}, {"type": "message", "id": "2", "parentId": "1", "message": {"role": "user", "content": "next"}}])
    got = interpret.pi_events(df).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(1, 5002)) and got[-1]["text"] == "next"
    chain = spark.range(1, 5001).selectExpr("'s' AS session", "id AS pos", "cast(id AS string) AS id", "nullif(cast(id - 1 AS string), '0') AS parent_id")
    side = spark.createDataFrame([("s", 0, "x", "4"), ("t", 1, "a", "b"), ("t", 2, "b", "a")], "session string, pos long, id string, parent_id string")
    kept = relations.active_branch(chain.unionByName(side))
    assert {(r["session"], r["id"]) for r in kept.collect()} == {("s", str(k)) for k in range(1, 5001)} | {("t", "a"), ("t", "b")}
    assert relations.active_branch(chain.limit(0)).count() == 0


def said(role, content, **more):
    return {"type": role, "message": {"role": role, "content": content}} | more


def test_message_lines(spark, tmp_path):
    """Errors wait for a human's text or the end, an answer drops them; echoes, side chains and blank texts give no text events."""
    fault = lambda text, status=None: {"type": "system", "error": {"formatted": text, "status": status}}
    df = rows(spark, tmp_path, [
        said("user", " hi "), fault("first"), fault("401 API key is invalid.", 401), said("user", "again"), fault("lost"), said("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yes"}, {"type": "tool_use", "id": "c", "name": "Bash", "input": {}}]),
        said("user", [{"type": "tool_result", "tool_use_id": "c", "content": "x\nError: no"}, {"type": "tool_result", "tool_use_id": "d", "content": [], "is_error": "no"}, {"type": "tool_result", "tool_use_id": "e", "content": "Error: but", "is_error": False}]),
        said("user", "<command-name>/plan</command-name> <command-args> go on </command-args>"), said("user", "<bash-input>ls</bash-input>"), said("user", "[Request interrupted by user]"), said("user", "side", isSidechain=True), said("user", "meta", isMeta=True),
        {"type": "attachment", "attachment": {"type": "queued_command", "prompt": "also", "humanTurn": True}}, {"type": "attachment", "attachment": {"type": "queued_command", "prompt": "note", "origin": {"kind": "task"}}}, said("user", "summary", isCompactSummary=True),
        said("assistant", [{"type": "text", "text": "  "}]), fault("Connection dropped"), said("user", "hook", origin={"kind": "hook"}),
    ])
    got = claude.events(df).orderBy("seq").collect()
    assert [(r["type"], r["text"] or r["name"], r["origin"]) for r in got] == [
        ("user_message", "hi", None), ("assistant_message", "401 API key is invalid.", None), ("user_message", "again", None), ("thinking", "hm", None), ("assistant_message", "yes", None), ("tool_call", "Bash", None),
        ("tool_result", "x\nError: no", None), ("tool_result", "[]", None), ("tool_result", "Error: but", None), ("user_message", "go on", None), ("user_message", "<bash-input>ls</bash-input>", "injected"), ("user_message", "also", "human"),
        ("user_message", "summary", "system"), ("assistant_message", "Connection dropped", None),
    ]
    assert [r["result_status"] for r in got if r["type"] == "tool_result"] == ["error", "unknown", "ok"]
    assert [(r["error_code"], r["error_kind"], r["retryable"]) for r in got if r["error_kind"]] == [("401", "auth", False), (None, "provider_error", True)]
    assert claude.events(df.limit(0)).count() == 0


def test_usage_of_message_lines(spark, tmp_path):
    """Missing stays missing, booleans and strings are no counts, labels alone are unscoped, repeated ids are told apart."""
    used = {"input_tokens": 5, "output_tokens": True, "cache_read_input_tokens": "7", "cache_creation": {"ephemeral_5m_input_tokens": 3}}
    df = rows(spark, tmp_path, [
        said("assistant", [], requestedModel="ask") | {"message": {"id": "m1", "model": " big ", "usage": used}}, {"type": "assistant", "effort": "high", "message": {"content": "x"}}, said("user", "plain"),
        {"type": "cost-state", "sessionId": "n", "modelUsage": {"a": {"inputTokens": 0, "costUSD": 0.5}, " a ": {"outputTokens": 2}, "b": {}, "c": 3}},
    ])
    got = collect.claude_observations(df).orderBy("pos", "sub").collect()
    assert [(r["observation_id"], r["scope"], r["model"], r["requested_model"], r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["cost"]) for r in got] == [
        ("claude:s:line:1:usage", "message", "big", "ask", 5, None, None, None), ("claude:s:line:2:attribution", "unknown", None, None, None, None, None, None),
        ("claude:s:line:4:modelUsage:a", "session", "a", None, None, 2, None, None), ("claude:s:line:4:modelUsage:a#2", "session", "a", None, 0, None, None, 0.5),
    ]
    assert got[0]["subdivisions"] == {"cache_creation_5m": 3} and got[1]["reasoning_level"] == "high"


def test_usage_of_items(spark, tmp_path):
    """The turn's last context names the model asked for, unless the record has one; thread counters take none."""
    record = lambda **p: {"type": "token_usage_record", "payload": p}
    df = rows(spark, tmp_path, [
        {"type": "turn_context", "payload": {"turn_id": "t", "model": "old", "effort": "low"}}, record(turn_id="t", response_id="r", thread_id="th", usage={"input_tokens": 1}, turn_token_usage={"total_tokens": 9}, thread_token_usage={"input_tokens": 4}),
        record(turn_id="t", model="own", usage={"output_tokens": 2}), {"type": "turn_context", "payload": {"turn_id": "t", "model": "new"}}, {"type": "event_msg", "payload": {"info": {"total_token_usage": {"input_tokens": 3}}}}, record(turn_id="t", usage={}),
    ])
    got = collect.codex_observations(df).orderBy("pos", "sub").collect()
    assert [(r["scope"], r["counter"], r["scope_id"], r["model"], r["requested_model"], r["reasoning_level"]) for r in got] == [
        ("turn", "cumulative", "r", None, "new", "low"), ("call", "absolute", "r", None, "new", "low"), ("session", "cumulative", "th", None, None, None), ("call", "absolute", "t", "own", None, "low"), ("unknown", "cumulative", None, None, None, None),
    ]
