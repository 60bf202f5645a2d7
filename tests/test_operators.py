"""Operators against plain versions and at their boundaries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loglattice.functions import guards, text
from loglattice.operators import conformance, filters, intervals, listing, matching, ordered, relations, skills, turns, usage
from loglattice.sources import jsonl

EVENT = "session string, seq long, type string, text string, origin string, call_id string, turn_id string, error_kind string, stop_reason string"


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def events(spark, rows):
    """Rows ``(session, seq, type, more)``."""
    names = ("text", "origin", "call_id", "turn_id", "error_kind", "stop_reason")
    return spark.createDataFrame([(s, q, t, *[more.get(n) for n in names]) for s, q, t, more in rows], EVENT)


def test_gap_is_inclusive_and_measured_from_the_last_stamp(spark):
    s = 1_000_000
    stamps = spark.createDataFrame([("a", 0), ("a", 300 * s), ("a", 600 * s + s // 2), ("b", 5 * s), ("c", None)], "session string, t long")
    assert rows_of(intervals.active_intervals(stamps, ["session"])) == [("a", 0, 360 * s, 2), ("a", 600 * s + s // 2, 660 * s + s // 2, 1), ("b", 5 * s, 65 * s, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_two_level_scans_match_plain_ones(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), k, rng.choice([None, 1, 2])) for k in range(80)]
    df = spark.createDataFrame(rows, "session string, seq long, v long")
    total, last, want = {}, {}, []
    for session, k, v in rows:
        total[session] = total.get(session, 0) + (v or 0)
        last[session] = v if v is not None else last.get(session)
        want.append((session, k, total[session], last[session]))
    summed = ordered.running_sum(df, ["session"], "seq", F.coalesce("v", F.lit(0)), "total", bucket=7)
    both = ordered.carry_forward(summed, ["session"], "seq", F.col("v"), "last", bucket=7).select("session", "seq", "total", "last")
    assert rows_of(both) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_union_and_peak(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.choice("xy"), a, a + rng.randrange(0, 9)) for a in (rng.randrange(60) for _ in range(50))]
    df = spark.createDataFrame(spans, "p string, a long, b long").withColumn("n", F.lit(1))
    for name in "xy":
        own = [(a, b) for p, a, b in spans if p == name and b > a]
        covered = {t for a, b in own for t in range(a, b)}
        open_at = {t: sum(a <= t < b for a, b in own) for t in range(80)}
        peak = max(open_at.values())
        got = intervals.union_length(df, ["p"]).filter(F.col("p") == name).first()
        assert round(got["union_seconds"] * 1e6) == len(covered)
        top = intervals.peak_concurrency(df, ["p"], bucket=10).filter(F.col("p") == name).first()
        assert (top["peak"], top["peak_at_us"]) == (peak, min(t for t, n in open_at.items() if n == peak))


def test_touching_intervals(spark):
    df = spark.createDataFrame([(0, 100, 1), (100, 200, 1)], "a long, b long, n int")
    assert intervals.peak_concurrency(df, []).first()["peak"] == 1
    assert intervals.clip(df, 100, 150).count() == 1
    assert intervals.weekday_hours(df).agg(F.sum("seconds")).first()[0] == pytest.approx(200e-6)


def test_turn_rules(spark):
    log = events(spark, [
        ("recovered", 1, "user_message", {}), ("recovered", 2, "assistant_message", {"error_kind": "timeout"}), ("recovered", 3, "assistant_message", {"text": "ok"}),
        ("failed", 1, "user_message", {"turn_id": "t9"}), ("failed", 2, "assistant_message", {"error_kind": "auth"}),
        ("stopped", 1, "user_message", {}), ("stopped", 2, "assistant_message", {}), ("stopped", 3, "lifecycle", {"text": "turn_aborted"}),
        ("waiting", 1, "assistant_message", {}), ("waiting", 2, "user_message", {}),
        ("calling", 1, "user_message", {}), ("calling", 2, "tool_call", {"call_id": "c"}),
        ("answered", 1, "user_message", {}), ("answered", 2, "tool_call", {"call_id": "c"}), ("answered", 3, "tool_result", {"call_id": "c"}),
    ])
    found = turns.turns(log)
    assert {(r["session"], r["turn_index"]): r["status"] for r in found.collect()} == {
        ("recovered", 0): "completed", ("failed", 0): "failed", ("stopped", 0): "interrupted", ("waiting", 0): "completed", ("waiting", 1): "in_progress", ("calling", 0): "unknown", ("answered", 0): "completed",
    }
    assert {r["turn_id"] for r in found.filter("session = 'failed'").collect()} == {"t9"}
    assert {r["session"]: r["status"] for r in turns.session_outcomes(found).collect()}["waiting"] == "pending"


def plain_pairs(rows):
    out = []
    for session in {r[0] for r in rows}:
        open_ids, stack = {}, []
        for _, seq, kind, more in sorted((r for r in rows if r[0] == session), key=lambda r: r[1]):
            key = more.get("call_id")
            if kind == "tool_call" and key is None:
                stack.append(seq)
            elif kind == "tool_call" and key in open_ids:
                out.append((session, key, seq, None))
            elif kind == "tool_call":
                open_ids[key] = seq
            elif key in open_ids:
                out.append((session, key, open_ids.pop(key), seq))
            else:
                out.append((session, key, stack.pop() if stack else None, seq))
        out += [(session, k, seq, None) for k, seq in open_ids.items()] + [(session, None, seq, None) for seq in stack]
    return sorted(out, key=repr)


def test_pairing_in_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), k, rng.choice(["tool_call", "tool_result"]), {"call_id": rng.choice([None, "x", "y", "z"])}) for k in range(200)]
    for bucket in (1 << 16, 7, 1):
        assert rows_of(matching.in_order(events(spark, rows), bucket)) == plain_pairs(rows)
    assert matching.in_order(events(spark, [])).count() == 0


def test_stacks_and_queues_by_walking(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), k, rng.random() < 0.5) for k in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "session string, seq long, opens boolean, level int").drop("level")
    for find, take in ((matching.stack_pairs, -1), (matching.queue_pairs, 0)):
        want = []
        for session in ("a", "b", None):
            held = []
            for _, seq, opens in (r for r in rows if r[0] == session):
                if opens:
                    held.append(seq)
                else:
                    want.append((session, held.pop(take) if held else None, seq))
            want += [(session, seq, None) for seq in held]
        for bucket in (1 << 16, 11):
            assert rows_of(find(df, ["session"], bucket=bucket)) == sorted(want, key=repr)


def test_reconcile(spark):
    schema = "session string, pos long, response_id string, turn_id string, scope string, model string, i long, o long"
    obs = spark.createDataFrame([
        ("s", 1, "r", None, "call", "m", 5, None), ("s", 2, "r", None, "call", "m", 5, None), ("s", 3, "q", None, "call", "m", 5, 1), ("s", 4, "q", None, "call", "m", 6, 1),
        ("s", 5, None, "t", "turn", "first", 1, 1), ("s", 6, None, "t", "turn", "second", 9, 9), ("s", 7, None, None, "call", None, None, None),
    ], schema)
    got = {r["record_key"]: (r["confidence"], r["model"], r["i"], r["o"]) for r in usage.reconcile(obs, ["i", "o"]).collect()}
    assert got == {"response|r": ("equal", "m", 5, None), "response|q": ("conflicted", "m", None, None), "turn|t": ("latest", "first", 9, 9), "record|7": ("single", None, None, None)}


def test_missing_is_not_zero(spark):
    details = spark.createDataFrame([("s", "t", None)], "session string, turn_id string, amount long")
    none = details.limit(0)
    row = usage.session_totals(usage.turn_residuals(details, none), none.select("session", "amount")).first()
    assert row["known_total"] is None and row["coverage"] == "not_recorded"


def test_native_counters(spark):
    values = ["5", "5.0", "5.5", "-1", "true", '"5"', "null", "0", "9007199254740993", "[1]"]
    df = spark.createDataFrame([(f'{{"k": {v}}}',) for v in values], "raw string")
    assert [r[0] for r in df.select(guards.counter(guards.native("raw", "$.k"))).collect()] == [5, 5, None, None, None, None, None, 0, 9007199254740993, None]
    labels = spark.createDataFrame([('{"k": "\\u2003 a b\\n"}',), ('{"k": "  "}',), ('{"k": 1}',)], "raw string")
    assert [r[0] for r in labels.select(guards.label(guards.native("raw", "$.k"))).collect()] == ["a b", None, None]


@pytest.mark.parametrize(("kind", "code", "message", "want"), [
    ("", "", "Too many requests", ("rate_limited", True)), ("", "429", "unauthorized", ("rate_limited", True)), ("", "", "The user refused: quota", ("unknown", None)), ("aborted", None, "", ("user_interrupt", False)),
    ("", "401", "", ("auth", False)), ("", "", "error 404 here", ("provider_error", False)), ("provider", "", "", ("provider_error", True)), ("", "502", "", ("provider_error", True)), ("", "", "after retries", ("provider_error", False)), ("", "", "fine", ("unknown", None)),
])
def test_error_classes(spark, kind, code, message, want):
    df = spark.createDataFrame([(kind, code, message)], "k string, c string, m string")
    assert tuple(df.select(text.classify_error(F.col("k"), F.col("c"), F.col("m")).alias("e")).select("e.*").first()) == want


def test_text_rules(spark):
    df = spark.createDataFrame([("https://a.b/c\n\n> Fix   the\tbug \nmore",)], "t string")
    assert df.select(text.first_line(F.col("t"))).first()[0] == "Fix the bug"
    assert df.select(text.completion_id(F.lit("pending"), F.lit("a"), F.col("t"))).first()[0] == ""
    assert df.select(text.excerpt(F.lit("x" * 200))).first()[0] == "x" * 119 + "…"
    assert df.select(text.tool_kind(F.lit(" Bash "))).first()[0] == "shell"


def test_chains_end_and_cycles_stop_at_their_last_new_node(spark):
    nodes = spark.createDataFrame([(k,) for k in "abcdxyz"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("c", "gone"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = {r["node"]: r["target"] for r in relations.resolve_chains(nodes, edges).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "d": "d", "x": "y", "y": "x", "z": "z"}


def test_active_branch(spark):
    rows = [("s", k, f"n{k}", f"n{k - 1}" if k else None) for k in range(150)] + [("s", 150, "side", "n3"), ("s", 151, "leaf", "n140")]
    rows += [("flat", 0, "a", None), ("flat", 1, None, None), ("loop", 0, "a", "b"), ("loop", 1, "b", "a"), ("torn", 0, "a", None), ("torn", 1, "b", "gone")]
    got = relations.active_branch(spark.createDataFrame(rows, "session string, pos long, id string, parent_id string"))
    found = {}
    for r in got.collect():
        found.setdefault(r["session"], set()).add(r["pos"])
    assert found == {"s": {*range(141), 151}, "flat": {0, 1}, "loop": {0, 1}, "torn": {1}}


def test_lists_and_pages(spark):
    df = spark.createDataFrame([("a", "x", 5), ("a", "y", None), ("b", "z", 9), ("b", "w", 9)], "source string, id string, mtime long")
    assert [r["id"] for r in listing.recent(df).collect()] == ["w", "z", "x", "y"]
    assert [r["id"] for r in listing.recent(df, depth=1).collect()] == ["w", "x"]
    assert [r["id"] for r in listing.page(df, ["id"], 1, 2).collect()] == ["x", "y"]
    assert [r["id"] for r in listing.resolve(df, "x").collect()] == ["x"]


def test_skills_once_per_round(spark):
    log = events(spark, [("s", 1, "user_message", {}), ("s", 2, "assistant_message", {}), ("s", 3, "user_message", {"origin": "injected"}), ("s", 4, "assistant_message", {}), ("s", 5, "user_message", {})])
    assert [r["round"] for r in skills.with_rounds(log).orderBy("seq").collect()] == [1, 1, 1, 1, 2]
    uses = spark.createDataFrame([("s", 1, 2, "/a:plan", "passive", "inferred"), ("s", 1, 4, "plan", "explicit", "native"), ("s", 2, 5, "$plan", "passive", "inferred"), ("s", 2, 6, " ", "passive", "inferred")], "session string, round long, seq long, name string, trigger string, origin string")
    once = skills.once_per_round(uses)
    assert rows_of(once.select("round", "seq", "bare", "trigger", "origin")) == [(1, 4, "plan", "explicit", "native"), (2, 5, "plan", "passive", "inferred")]
    assert skills.summary(once).first()["total"] == 2


def test_one_key_holding_all_rows_is_cut_into_buckets(spark):
    """Islands, repeats and numbers are the same with many small buckets as with one."""
    rows = [("k", x, x + (x % 7 == 0) * 40) for x in range(0, 3000, 5) if x % 200 < 150]
    df = spark.createDataFrame(rows, "k string, lo long, hi long")
    whole, cut = (sorted(tuple(r) for r in ordered.islands(df, ["k"], 6, b).select("k", "lo", "hi", "n").collect()) for b in (1 << 40, 16))
    assert whole == cut and len(whole) == 15
    log = spark.createDataFrame([("k", x, None if x % 50 < 10 else x // 20) for x in range(1000)], "k string, seq long, v long")
    whole, cut = (sorted(r["seq"] for r in ordered.drop_repeats(log, ["k"], "seq", ["v"], b).collect()) for b in (1 << 40, 8))
    assert whole == cut and whole[0] == 0
    strict = ordered.carry_forward(log, ["k"], "seq", F.when(F.col("seq") % 30 == 0, F.col("seq")), "last", 8, strict=True)
    assert {r["seq"]: r["last"] for r in strict.collect()} == {x: (x - 1) // 30 * 30 if x else None for x in range(1000)}


def test_pages_cursors_and_references(spark):
    rows = spark.createDataFrame([("a", "s1", 3.0), ("a", "s12", 1.0), ("b", "s1", 2.0), ("b", "t5", None)], "source string, id string, mtime double")
    first, token = filters.page_after(rows, ["id", "source"], "g", size=3)
    second, _ = filters.page_after(rows, ["id", "source"], "g", token, 3)
    assert [r["id"] for r in first.collect()] == ["s1", "s1", "s12"] and [r["id"] for r in second.collect()] == ["t5"]
    for bad in ("?", filters.encode_cursor("other", 3), filters.encode_cursor("g", -1)):
        with pytest.raises(ValueError):
            filters.decode_cursor(bad, "g")
    verdicts = {ref: tuple(filters.resolve_reference(rows, ref).select("verdict", "n").first()) for ref in ("s1", "b:s1", "s12", "t", "zz", "")}
    assert verdicts == {"s1": ("ambiguous", 3), "b:s1": ("found", 1), "s12": ("found", 1), "t": ("found", 1), "zz": ("not_found", 0), "": ("not_found", 0)}
    assert filters.select_sessions(rows, since=0).count() == 3 and filters.select_sessions(rows.limit(0), since=0).count() == 0


def test_markers_are_found_in_one_pass():
    """The pattern that stands before the rules matches exactly where some marker is."""
    words = ["abc", "abd", "ab", "xyz", "x", "429", "to"]
    assert {w for w in ["zabz", "a b", "wxw", "42 9", "4290", "tow", "t o"] if re.search(text.any_of(words), w)} == {"zabz", "wxw", "4290", "tow"}
    every = [m for group in text._MARKERS for m in group]
    assert all(re.search(text._ANY, f"..{m}..") for m in every) and re.search(text._ANY, "an api_ error") and not re.search(text._ANY, "plain words 40 1 and 50 3")


def test_conformance_rules(spark):
    log = events(spark, [(None, 1, "tool_call", {"call_id": "c"}), (None, 2, "tool_result", {"call_id": "c"}), ("s", 1, "user_message", {"text": "hi"}), ("s", 3, "tool_result", {"call_id": "x"}), ("s", 4, "assistant_message", {"text": "yes"})])
    view = turns.conversation(log).select("session", "seq", "role", "text")
    assert rows_of(conformance.all_rules(log, view).select("session", "rule")) == [("s", "seq"), ("s", "tool_pairing")]
    told = rows_of(conformance.conversation_view(log, view.filter("seq = 4").union(view.filter("seq = 4"))).select("rule", "detail"))
    assert told == [("conversation", "not in the events"), ("conversation", "not in the view")]
    statused = spark.createDataFrame([("s", 1, "tool_result", "ok"), ("s", 2, "tool_result", None), ("s", 3, "tool_result", "odd"), ("s", 4, "tool_call", None)], "session string, seq long, type string, result_status string")
    assert [r["detail"] for r in conformance.statuses(statused).orderBy("detail").collect()] == ["result 2", "result 3"]
    assert conformance.all_rules(log.limit(0), view.limit(0)).count() == 0


def test_orders_of_lists_and_ids_of_both_sides(spark):
    hits = spark.createDataFrame([("a", 5, 1.0), ("b", 9, None), ("c", 5, 2.0), ("d", 5, None)], "id string, score int, mtime double")
    assert [r["id"] for r in filters.ranked_hits(hits).collect()] == ["b", "c", "a", "d"]
    book = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 3.0)], "id string, active double")
    assert [r["id"] for r in filters.by_activity(book).collect()] == ["c", "a", "b"]
    one, two = (spark.createDataFrame([("s", x) for x in ids], "session string, id string") for ids in ("aab", "bc"))
    assert rows_of(filters.distinct_ids(one, two, ["session", "id"])) == [("s", "a"), ("s", "b"), ("s", "c")]
    files = spark.createDataFrame([("s", 1.0, "old"), ("s", 2.0, "new"), ("t", 1.0, "only"), ("s", 2.0, "tied")], "session string, mtime double, path string")
    assert {r["path"] for r in jsonl.last_generation(files).collect()} == {"new", "tied", "only"}
    times = spark.createDataFrame([(None, 10.0), (10.0, 20.0), (10.0, 3610.0), (10.0, 3611.0)], "e double, f double")
    assert [r[0] for r in times.select(guards.effective_time(F.col("e"), F.col("f"))).collect()] == [10.0, 20.0, 3610.0, 10.0]


def test_choices_of_performance_and_skills(spark):
    records = spark.createDataFrame([(1, "t", "m", None), (2, "t", None, "m"), (3, "u", "m", "m"), (4, None, None, None)], "k int, turn_id string, message_id string, response_id string")
    kept = lambda *choice: [r["k"] for r in filters.select_performance(records, *choice).orderBy("k").collect()]
    assert kept() == [1, 2, 3, 4] and kept("t") == [1, 2] and kept(None, "m") == [1, 2, 3] and kept("t", "x") == [1, 2] and kept("x") == []
    uses = spark.createDataFrame([(1, "explicit"), (2, "auto"), (3, None)], "k int, trigger string")
    assert [[r["k"] for r in filters.select_skills(uses, t).orderBy("k").collect()] for t in ("all", "explicit", "passive")] == [[1, 2, 3], [1], [2, 3]]
    with pytest.raises(ValueError):
        filters.select_skills(uses, "some")
