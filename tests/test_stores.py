"""Two dialects whose results find their calls out of order, against plain walks."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loglattice.operators import ordered
from loglattice.sources import blobs, parts, steps

FAILED = re.compile(r"^(?:exit code:?\s*[1-9]|error:|traceback \(most recent call last\)|command failed|fatal:)", re.I | re.M)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


# --- message blobs ------------------------------------------------------------


def blob_lines(rng, n):
    out = []
    for _ in range(n):
        kind, ref = rng.random(), f"c{rng.randrange(n // 3)}"
        if kind < 0.35:
            parts = [{"type": "tool-result", "toolCallId": rng.choice([ref, ref, ""]), "result": rng.choice(["fine", "error: no", "", {"a": 1}, None])} for _ in range(rng.randrange(1, 3))]
            out.append({"role": "tool", "content": [*parts, {"type": "noise"}, "x"]})
        elif kind < 0.75:
            parts = [
                rng.choice([{"type": "tool-call", "toolCallId": ref, "toolName": rng.choice(["Bash", None])}, {"type": "reasoning", "text": "", "thinking": " hm ", "providerOptions": {"cursor": {"modelName": " m1 "}}}, {"type": "text", "text": rng.choice(["so ", " "])}, "stray", {"type": "tool-call"}])
                for _ in range(rng.randrange(3))
            ]
            out.append({"role": "assistant", "content": rng.choice([parts, parts, " plain ", ""])})
        elif kind < 0.95:
            text = rng.choice(["<user_query>\n do it \n</user_query>", "short", "<user_info>x", "x" * 2001, "[Previous conversation summary]: y", " ", "<user_query> </user_query>"])
            out.append({"role": "user", "content": rng.choice([text, [{"type": "text", "text": text}, {"text": "more"}, "end"], [{"type": "image"}]])})
        else:
            out.append(rng.choice([[1], {"role": "system", "content": "s"}, "broken"]))
    return out


def plain_blobs(lines):
    events, pending, seen = [], {}, set()

    def add(kind, pos, **more):
        if kind in ("user_message", "assistant_message", "thinking") and not (more.get("text") or "").strip():
            return
        events.append((pos, kind, *[more.get(c) for c in blobs.COLUMNS[1:]]))

    def result(call_id, output, pos):
        status = "error" if isinstance(output, str) and FAILED.search(output[:600]) else "unknown"
        add("tool_result", pos, call_id=call_id, text=output if isinstance(output, str) else json.dumps(output, separators=(",", ":")), result_status=status)

    for pos, obj in enumerate(lines):
        if not isinstance(obj, dict):
            continue
        content = obj["content"]
        if obj["role"] == "user":
            if isinstance(content, str):
                raw = content
            else:
                pieces = [p if isinstance(p, str) else p.get("text", "") if p.get("type", "text") == "text" else "" for p in content]
                raw = "\n".join(p for p in pieces if p)
            found = re.search(r"<user_query>\s*(.*?)\s*</user_query>", raw, re.S)
            typed = None
            if not raw.lstrip().startswith("[Previous conversation summary]:"):
                typed = found.group(1).strip() if found else None if "<" in raw[:80] or len(raw) > 2000 else raw.strip()
            add("user_message", pos, text=typed or raw.strip(), origin="human" if typed else "injected")
        elif obj["role"] == "assistant" and isinstance(content, str):
            add("assistant_message", pos, text=content.strip())
        elif obj["role"] == "assistant":
            names = [p["providerOptions"]["cursor"]["modelName"].strip() for p in content if isinstance(p, dict) and "providerOptions" in p]
            model = names[0] if names else None
            for part in content:
                if not isinstance(part, dict):
                    continue
                if part["type"] == "reasoning":
                    add("thinking", pos, text=(part["text"] or part["thinking"]).strip(), model=model)
                elif part["type"] == "text":
                    add("assistant_message", pos, text=part["text"].strip(), model=model)
                else:
                    call_id = part.get("toolCallId") or ""
                    add("tool_call", pos, call_id=call_id, name=part.get("toolName") or "tool")
                    if call_id:
                        seen.add(call_id)
                        if call_id in pending:
                            result(call_id, *pending.pop(call_id))
        elif obj["role"] == "tool":
            for part in content:
                if isinstance(part, dict) and part["type"] == "tool-result":
                    if part["toolCallId"] and part["toolCallId"] not in seen:
                        pending[part["toolCallId"]] = (part["result"], pos)
                    else:
                        result(part["toolCallId"], part["result"], pos)
    for call_id, (output, pos) in pending.items():
        result(call_id, output, pos)
    return events


def test_blob_events(spark):
    rng = random.Random(3)
    sessions = {name: blob_lines(rng, n) for name, n in (("a", 120), ("b", 40), (None, 30), ("one", 3))}
    rows = [(s, k, "{bro" if x == "broken" else json.dumps(x)) for s, lines in sessions.items() for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "session string, pos long, raw string").repartition(3)
    want = [(s, k, *e) for s, lines in sessions.items() for k, e in enumerate(plain_blobs(lines), 1)]
    assert rows_of(blobs.events(df)) == sorted(want, key=repr)
    assert sum(e[3] == "tool_result" for e in want) > 40
    assert blobs.events(df.limit(0)).count() == 0


# --- step transcripts ---------------------------------------------------------


def step_lines(rng, n, exact):
    out, step = [], 0
    for _ in range(n):
        kind = rng.random()
        step += 1
        row = {"step_index": step, "type": "PLANNER_RESPONSE", "source": "MODEL", "status": "DONE"}
        if kind < 0.12:
            content = rng.choice(["<USER_REQUEST> go </USER_REQUEST><ADDITIONAL_METADATA>x", "plain <ADDITIONAL_METADATA> y", "None", "", "hi\n<USER_SETTINGS_CHANGE>`Model Selection` from a to Gem 2.5. next</USER_SETTINGS_CHANGE>"])
            row |= {"type": "USER_INPUT", "source": rng.choice(["USER_EXPLICIT", "SYSTEM", "X"]), "content": content, "status": rng.choice(["DONE", "CANCELED"]), "media": rng.choice([None, [{"mime_type": "image/png", "uri": " u "}, {"x": 1}, 5, {"uri": "v"}]])}
        elif kind < 0.5:
            calls = [rng.choice([{"name": "run"}, {"name": "run"}, {"name": ""}, "stray"]) for _ in range(rng.randrange(3))]
            row |= {"tool_calls": rng.choice([calls, calls, None, "x"]), "thinking": rng.choice([" hm ", "", None]), "content": rng.choice(["said ", "None", " ", None]), "status": rng.choice(["DONE", "DONE", "ERROR", "CANCELLED"]), "error": rng.choice([None, None, " bad "])}
            row["media"] = rng.choice([None, None, [{"mime_type": "a/b"}]])
            out.append(row)
            if exact:
                out += [{"step_index": step + 1 + k, "type": "RUN_COMMAND", "status": "DONE", "content": "ok"} for k, c in enumerate(calls) if isinstance(c, dict) and row["tool_calls"] == calls]
                step += len(calls)
            continue
        elif kind < 0.8 and not exact:
            row |= {"type": rng.choice(["RUN_COMMAND", "ODD"]), "step_index": rng.choice([step, step - 1, step + 2, None, True, 1.5]), "status": rng.choice(["DONE", "ERROR", "INVALID", "RUNNING"]), "content": rng.choice(["out ", "", None]), "error": rng.choice([None, " e "])}
        else:
            row |= rng.choice([{"type": "CHECKPOINT", "content": " sum "}, {"type": "SYSTEM_MESSAGE", "status": "ERROR", "content": " s "}, {"type": "ERROR_MESSAGE", "status": "X", "error": "boom"}, {"type": "ODD", "source": "Y", "status": "CANCELED"}, {"type": "ODD", "source": "Y"}, {"type": 5}])
        out.append(row)
    return out


def plain_steps(lines):
    events, ids, by_step, queue, model = [], set(), {}, [], None

    def add(kind, **more):
        if kind in ("user_message", "assistant_message", "thinking") and not (more.get("text") or "").strip():
            return
        events.append((kind, *[more.get(c) for c in steps.FIELDS[1:]], model))

    for pos, row in enumerate(lines):
        if not isinstance(row.get("type"), str) or "step_index" not in row:
            continue
        kind, source, status = row["type"], row.get("source") or "", (row.get("status") or "").upper()
        content = row.get("content") or ""
        media = "\n".join(f"[{m.get('mime_type') or 'media'}] {m.get('uri', '').strip()}".strip() for m in row.get("media") or [] if isinstance(m, dict) and (m.get("mime_type") or m.get("uri")))
        aborted = status in steps.ABORTED
        failure = (row.get("error") or "").strip() or (content.strip() if aborted else "")
        breaks = failure or ("canceled" if "CANCEL" in status else "error")
        step = row["step_index"] if type(row["step_index"]) is int else None
        if kind == "USER_INPUT":
            by_step, queue = {}, []
            found = re.search(steps.MODEL, content.split("<USER_SETTINGS_CHANGE>")[-1].split("</USER_SETTINGS_CHANGE>")[0]) if "<USER_SETTINGS_CHANGE>" in content else None
            model = (found.group(1).strip().rstrip(".").strip() if found else None) or model
            inner = re.search("<USER_REQUEST>(.*?)</USER_REQUEST>", content, re.S)
            text = inner.group(1).strip() if inner else content.split("<ADDITIONAL_METADATA>")[0].split("<USER_SETTINGS_CHANGE>")[0].strip()
            origin = {"USER_EXPLICIT": "human", "SYSTEM": "system"}.get(source, "unknown")
            if text and text != "None":
                add("user_message", text=text, origin=origin)
            elif media:
                add("user_message", text=media, origin=origin)
            elif aborted:
                add("assistant_message", text=breaks, error=breaks)
        elif kind == "SYSTEM_MESSAGE":
            if aborted:
                add("assistant_message", text=breaks, error=breaks)
        elif kind == "CHECKPOINT":
            add("compaction", text=content.strip() or None)
        elif kind == "PLANNER_RESPONSE":
            add("thinking", text=(row.get("thinking") or "").strip())
            said = content.strip() if content.strip() != "None" else ""
            if aborted and not said:
                add("assistant_message", text=breaks, error=breaks)
            elif said:
                add("assistant_message", text=said, error=failure if aborted else None)
            elif media and not row.get("tool_calls"):
                add("assistant_message", text=media)
            for k, call in enumerate(row["tool_calls"] if isinstance(row.get("tool_calls"), list) else []):
                if isinstance(call, dict):
                    call_id = f"{step if step is not None else k}-{k}"
                    call_id = f"{call_id}:{pos}" if call_id in ids else call_id
                    ids.add(call_id)
                    add("tool_call", call_id=call_id, name=call.get("name") or "tool")
                    queue.append(call_id)
                    if step is not None:
                        by_step[step + 1 + k] = call_id
        elif kind in steps.RESULTS or (source == "MODEL" and kind not in steps.OTHERS):
            if step is not None and step in by_step:
                call_id = by_step.pop(step)
                if call_id in queue:
                    queue.remove(call_id)
            elif queue:
                call_id = queue.pop(0)
                by_step = {k: v for k, v in by_step.items() if v != call_id}
            else:
                call_id = ""
            output = content.strip() or (row.get("error") or "").strip() or (status.lower() if status in ("ERROR", "INVALID") else "")
            output = "\n".join(x for x in (output, media) if x)
            if output or call_id:
                add("tool_result", call_id=call_id, text=output, result_status={"DONE": "ok", "ERROR": "error", "INVALID": "error"}.get(status, "unknown"))
        elif kind == "ERROR_MESSAGE" or aborted:
            add("assistant_message", text=breaks, error=breaks)
    return events


@pytest.mark.parametrize("exact", [True, False])
def test_step_events(spark, exact):
    rng = random.Random(9)
    sessions = {name: step_lines(rng, n, exact) for name, n in (("a", 150), ("b", 60), ("c", 40), (None, 40), ("one", 2))}
    rows = [(s, k, json.dumps(x)) for s, lines in sessions.items() for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "session string, pos long, raw string").repartition(3)
    want = [(s, k, *e) for s, lines in sessions.items() for k, e in enumerate(plain_steps(lines), 1)]
    assert rows_of(steps.events(df)) == sorted(want, key=repr)
    assert sum(e[2] == "tool_result" for e in want) > 40
    assert steps.events(df.limit(0)).count() == 0


def test_a_store_is_parsed_once_and_joined_before_it_is_numbered(spark):
    """Every message and part is read once; odd rows of both give what their rules say."""
    gone = {"name": "MessageAbortedError", "data": {"message": " gone ", "statusCode": 429}}
    messages = [
        ("s", "m1", 1, {"role": "user"}), ("s", "m2", 2, {"role": "assistant", "error": gone}), ("s", "m2", 2, {"role": "assistant", "error": gone}), ("s", "m3", 2, {"role": "assistant", "error": "plain"}), ("s", "m4", 3, {"role": "assistant", "finish": "stop"}),
        ("s", "m5", 4, {"role": "assistant", "error": None}), ("s", "m6", 5, [{"role": "user"}]), (None, None, 6, {"role": "assistant", "error": {"data": {"message": " "}, "text": "x"}}), ("s", "m7", 7, {"role": "assistant", "error": gone}),
    ]
    own = [
        ("m1", "p1", {"type": "text", "text": " a "}), ("m1", "p2", {"type": "text", "text": "b", "synthetic": True}), ("m1", "p3", [{"type": "text", "text": "c"}]), ("m2", "p1", {"type": "tool", "callID": " ", "state": {"status": "completed", "output": "o"}}), ("m2", "p2", {"type": "text", "text": " "}),
        ("m3", "p1", {"type": "compaction", "state": {"summary": " sum "}}), ("m6", "p1", {"type": "text", "text": "d"}), (None, "p1", {"type": "text", "text": "e"}), ("m7", "p1", {"type": "text", "text": "f"}),
    ]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(data):
        seen.add(1)
        return data

    held = spark.createDataFrame([(s, i, t, json.dumps(d)) for s, i, t, d in messages], "session string, id string, created long, data string").withColumn("data", told("data"))
    made = spark.createDataFrame([(m, i, 0, json.dumps(d)) for m, i, d in own if m], "message_id string, id string, created long, data string").withColumn("data", told("data"))
    log = parts.events(held, made)
    got = sorted(log.collect(), key=lambda r: (r["session"] or "", r["seq"]))
    assert seen.value == len(messages) + len(own) - 1
    assert [(r["session"], r["seq"], r["type"], r["text"] or r["name"], r["call_id"], r["error_kind"]) for r in got] == [
        (None, 1, "assistant_message", "x", None, "provider_error"), ("s", 1, "user_message", "a", None, None), ("s", 2, "tool_call", "tool", "p1", None), ("s", 3, "tool_call", "tool", "p1", None), ("s", 4, "tool_result", "o", "p1", None), ("s", 5, "tool_result", "o", "p1", None),
        ("s", 6, "thinking", "sum", None, None), ("s", 7, "lifecycle", "empty assistant message", None, None), ("s", 8, "assistant_message", "f", None, "user_interrupt"),
        ("s", 9, "assistant_message", "429: gone", None, "user_interrupt"), ("s", 10, "assistant_message", "plain", None, "provider_error"),
    ]


def test_numbers_within_a_place_join_counts_only(spark):
    rows = [(k, p, s) for k in ("a", None) for p in (5, None, 1 << 62, 70000) for s in range(40)]
    df = spark.createDataFrame(rows, "k string, p long, s int").repartition(3)
    out = ordered.numbered_within(df, ["k"], "p", "s", "n")
    place = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {(k, *x): n for k in ("a", None) for n, x in enumerate([r[1:] for r in sorted((r for r in rows if r[0] == k), key=place)], 1)}
    assert {(r["k"], r["p"], r["s"]): r["n"] for r in out.collect()} == want and out.columns == ["k", "p", "s", "n"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # of the counts only
