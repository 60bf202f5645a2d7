"""Frames and lines of feeds."""

import random

import pytest

from loglattice.streaming import framing


def plain(lines):
    out, data = [], []
    for pos, raw in enumerate(lines):
        raw = (raw or "").removesuffix("\r")
        if not raw:
            if data:
                out.append((pos, "\n".join(data)))
            data = []
        elif raw.startswith("data:"):
            data.append(raw[5:].removeprefix(" "))
    return out


@pytest.mark.parametrize("bucket", [1 << 16, 5])
def test_frames(spark, bucket):
    rng = random.Random(1)
    pieces = ["data: {", "data:{}", "data: ", "data:  x", '\tdata: "y"', "data: 1}\r", "", "\r", None, ": note", "event: e", "data", 'data: {"a":', "data: 1}"]
    feeds = {s: [rng.choice(pieces) for _ in range(n)] for s, n in (("a", 200), ("b", 31), (None, 40), ("c", 1))}
    df = spark.createDataFrame([(s, k, x) for s, lines in feeds.items() for k, x in enumerate(lines)], "session string, pos long, raw string").repartition(3)
    got = {(r["session"], r["pos"]): (r["raw"], r["state"]) for r in framing.frames(df, bucket).collect()}
    want = {(s, pos): raw for s, lines in feeds.items() for pos, raw in plain(lines)}
    assert {k: v[0] for k, v in got.items()} == want
    assert {v[1] for v in got.values() if v[0] == "{}"} <= {"ok"} and {v[1] for v in got.values() if v[0] == "{"} <= {"malformed"}
    assert framing.frames(df.limit(0)).count() == 0


def test_lines_and_long_events(spark, monkeypatch):
    monkeypatch.setattr(framing, "LONGEST", 12)
    lines = [(0, '{"a": 1}\r'), (1, " "), (2, None), (3, "[1]"), (4, "{"), (5, '{"a": 123456789}'), (6, "data: 123456"), (7, "data: 12345"), (8, ""), (9, "data: 123456"), (10, "data: 123456"), (11, "")]
    df = spark.createDataFrame([("s", *x) for x in lines], "session string, pos long, raw string")
    told = [(r["pos"], r["state"], r["raw"]) for r in framing.json_lines(df.filter("pos < 6")).orderBy("pos").collect()]
    assert told == [(0, "ok", '{"a": 1}'), (3, "non_object", "[1]"), (4, "malformed", "{"), (5, "too_long", None)]
    assert [(r["pos"], r["state"], r["raw"]) for r in framing.frames(df.filter("pos > 5")).orderBy("pos").collect()] == [(8, "malformed", "123456\n12345"), (11, "too_long", None)]
