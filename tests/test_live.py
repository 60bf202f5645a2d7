"""Live sessions: any cut into batches gives the same records."""

import random

import pytest
from pyspark.sql import functions as F

from loglattice.streaming import live

SCHEMA = "session string, pos long, event_id string, op string, key string, kind string, text string, offset long, complete boolean"


def feed(seed=1):
    """Operations with repeats, resets, overlaps, gaps and conflicts."""
    rng, rows = random.Random(seed), []
    for session in ("a", "b", "c", None):
        texts, pos = {}, 0
        for _ in range(60):
            pos += rng.randrange(1, 3)
            key, kind = f"k{rng.randrange(5)}", rng.random()
            word = rng.choice(["ab", "é", "😀x", "東京"])
            event = f"e{rng.randrange(200)}" if rng.random() < 0.4 else None
            if kind < 0.25:
                rows.append((session, pos, event, "upsert", key, "assistant_message", word, None, rng.choice([None, True])))
            elif kind < 0.85:
                at = rng.choice([None, 0, 1, 2, 4, 40]) if rng.random() < 0.3 else None
                rows.append((session, pos, event, "append", key, "assistant_message", word, at, False))
            elif kind < 0.92:
                rows.append((session, pos, event, "remove", key, None, None, None, None))
            elif kind < 0.98:
                rows.append((session, pos, event, "reset", None, None, None, None, None))
            else:
                rows.append((session, pos, event, rng.choice(["noise", "upsert"]), None, None, word, None, None))
            texts[key] = word
    rows.append(("b", 10_000, None, "end", None, None, "done", None, None))
    rows.append(("b", 10_001, None, "upsert", "late", "x", "after the end", None, None))
    return rows


def plain(rows, limit=200):
    """The same by dictionaries, session by session."""
    out = []
    for session in dict.fromkeys(r[0] for r in rows):
        own, places, ring = live.Session(), {}, {}
        for row in sorted((r for r in rows if r[0] == session), key=lambda r: r[1]):
            op = dict(zip(live.COLUMNS, row[1:], strict=True))
            for r in own.step(op, places, ring, limit):
                out.append((session, *[r.get(c) for c in live.NAMES[1:]]))
    return out


def told(df):
    return sorted((tuple(r) for r in df.filter("type <> 'checkpoint'").collect()), key=repr)


def step(shown, *ops):
    own, out = live.Session(), []
    for pos, op in enumerate(ops):
        full = dict.fromkeys(live.COLUMNS) | {"pos": pos, "kind": "m", **op}
        out += own.step(full, {}, {}, 3)
    assert {k: v.text for k, v in own.shown.items()} == shown
    return [(r["type"], r.get("reason")) for r in out], own


def test_appends_are_checked_by_utf16_offsets():
    start = {"op": "upsert", "key": "k", "text": "a😀"}
    assert step({"k": "a😀bc"}, start, {"op": "append", "key": "k", "text": "😀bc", "offset": 1})[0] == [("upsert", None)] * 2
    assert step({"k": "a😀"}, start, {"op": "append", "key": "k", "text": "😀", "offset": 1})[0] == [("upsert", None)]
    for more, reason in (({"text": "b", "offset": 4}, "append_gap"), ({"text": "b", "offset": 1}, "append_conflict"), ({"key": "new", "text": "b", "offset": 0}, "append_without_start"), ({"text": "b", "offset": -1}, "append_gap")):
        told, own = step({"k": "a😀"}, start, {"op": "append", "key": "k", **more}, {"op": "upsert", "key": "z", "text": "lost"})
        assert told == [("upsert", None), ("error", reason)] and own.gap and own.broken
    told, own = step({"k": "x"}, start, {"op": "append", "key": "q", "text": "b", "offset": 0}, {"op": "reset"}, {"op": "upsert", "key": "k", "text": "x"})
    assert [t for t, _ in told] == ["upsert", "error", "reset", "upsert"] and not own.gap and own.generation == 2


def test_only_the_last_ids_are_remembered(monkeypatch):
    monkeypatch.setattr(live, "SEEN", 2)
    own, places, ring = live.Session(), {}, {}
    assert [own.first(e, places, ring) for e in "aabacabc"] == [True, False, True, False, True, True, True, True] and len(places) == 2


def test_unchecked_appends_equal_values_and_the_window():
    assert step({"k": "ab"}, {"op": "append", "key": "k", "text": "a"}, {"op": "append", "key": "k", "text": "b"})[1].gap
    assert step({"k": "a"}, {"op": "upsert", "key": "k", "text": "a"}, {"op": "upsert", "key": "k", "text": "a"})[0] == [("upsert", None)]
    told, own = step({"b": "1", "c": "1", "d": "1"}, *[{"op": "upsert", "key": k, "text": "1"} for k in "abcd"])
    assert told[-1] == ("remove", "window_limit") and own.truncated


def test_replay_equals_plain_version(spark):
    rows = feed()
    ops = spark.createDataFrame(rows + rows[::3], SCHEMA).withColumn("seq", F.lit(7)).repartition(3)
    assert told(live.replay(ops)) == sorted(plain(rows), key=repr)
    assert told(live.replay(ops, limit=2)) == sorted(plain(rows, 2), key=repr)
    assert live.replay(spark.createDataFrame([], SCHEMA)).count() == 0
    shown = {}
    for r in plain(rows):
        record = dict(zip(live.NAMES, r, strict=True))
        if record["type"] == "reset":
            shown = {k: v for k, v in shown.items() if k[0] != record["session"]}
        elif record["type"] == "upsert":
            shown[record["session"], record["key"]] = (record["kind"], record["text"], record["complete"])
        elif record["type"] == "remove":
            shown.pop((record["session"], record["key"]), None)
    records = live.replay(ops)
    assert {(r[0], r[1]): tuple(r[2:]) for r in live.state(records.union(records)).collect()} == shown


@pytest.mark.parametrize("cuts", [[100], [7, 31, 90, 160]])
def test_any_cut_into_batches_gives_the_batch(spark, tmp_path, cuts):
    rows = sorted(feed(3), key=lambda r: r[1])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, at = tmp_path / "in", 0
    for number, cut in enumerate([*cuts, len(rows)]):
        part = rows[max(0, at - 5) : cut]  # some are delivered twice
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")
        at = cut
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(folder))
        query = live.follow_to(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    assert told(got.select(*live.NAMES)) == sorted(plain(rows), key=repr)
    ends = got.filter("type = 'checkpoint'").groupBy("session").agg(F.max("seq").alias("seq"))
    want = {}
    for r in plain(rows):
        want[r[0]] = max(want.get(r[0], 0), r[1])
    assert {r["session"]: r["seq"] for r in ends.collect()} == want
