"""Files that grow, shrink and are replaced, read in batches of bytes and of time."""

import io
import json
import os
import random

import pytest
from oracle import TABLES, differences
from pyspark.sql import functions as F

from loglattice.plans import registry
from loglattice.sources import growing


def finished(data):
    """Start and text of the finished lines of a file."""
    lines = data.splitlines(keepends=True)
    if lines and not lines[-1].endswith(b"\n"):
        lines.pop()
    out, at = [], 0
    for line in lines:
        out.append((at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
        at += len(line)
    return out, at


CASES = [b"", b"\n", b"a", b"a\n", b"a\nb", b"a\r", b"a\rb", b"a\r\n", b"a\r\nb\r", b"\r\r\n\n\rx\n", "é ü\n東京\n\xff".encode("latin-1", "replace"), b"\xff\xfe\n{}\n"]
CASES += [bytes(random.Random(k).choice(b"ab\n\r") for _ in range(60)) for k in range(40)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 1 << 20])
def test_ranges_of_any_size_give_the_same_lines(chunk, monkeypatch):
    monkeypatch.setattr(growing, "CHUNK", chunk)
    for data in CASES:
        want, end = finished(data)
        handle = io.BytesIO(data)
        assert growing.committed_end(handle, len(data)) == end, data
        if end:
            assert growing.last_line_start(handle, end) == want[-1][0], data
        for size in (1, 2, 3, 7, 100):
            got = [x for a in range(0, end, size) for x in growing.lines_between(handle, a, min(end, a + size), end)]
            assert [(at, line.rstrip(b"\r\n").decode("utf-8", "replace")) for at, line in got] == want, (data, size)


def test_batch_read_numbers_lines_and_splits_files(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in ("a", "b/c", "empty"):
        path = tmp_path / f"{name}.jsonl"
        path.parent.mkdir(exist_ok=True)
        lines = [json.dumps({"k": k, "x": "y" * rng.randrange(60)}) if k % 7 else ["", "[1]", "{", "  "][k // 7 % 4] for k in range(0 if name == "empty" else 200)]
        path.write_text("".join(x + rng.choice(["\n", "\r\n", "\r"]) for x in lines) + '{"half": ')
        want |= {(path.name, k): x for k, (_, x) in enumerate(finished(path.read_bytes())[0], 1)}
    (tmp_path / "other.txt").write_text("no session\n")
    lines = growing.read(spark, f"file://{tmp_path}", rangeBytes=257)
    assert lines.rdd.getNumPartitions() > 20
    rows = growing.numbered(lines, bucket=300).select(F.element_at(F.split("path", "/"), -1).alias("name"), "pos", "raw", growing.line_state(F.col("raw")).alias("state")).collect()
    assert {(r["name"], r["pos"]): r["raw"] for r in rows} == want and len(rows) == len(want)
    assert {r["state"] for r in rows if r["raw"] == "[1]"} == {"non_object"} and {r["state"] for r in rows if r["raw"] == "{"} == {"malformed"} and {r["state"] for r in rows if r["raw"].strip() == ""} == {None}
    assert growing.read(spark, f"file://{tmp_path}/missing").count() == 0


def drain(spark, folder, work, out, n=97):
    """Everything new, in as many batches as it takes; rows in the order of batches."""
    stream = growing.follow(spark, f"file://{folder}", f"file://{work}/state", rangeBytes=n)
    query = stream.writeStream.foreachBatch(lambda df, number: out.extend((number, *r) for r in df.collect())).option("checkpointLocation", f"{work}/checkpoint").start()
    query.processAllAvailable()
    query.stop()


def view(out):
    """The lines that a consumer holds in the end: a reset empties its file."""
    held = {}
    for _, path, generation, start, kind, raw in sorted(out, key=lambda r: (r[0], r[1], r[2], r[3])):
        name = os.path.basename(path)
        if kind == "reset":
            held[name] = (generation, {})
        held.setdefault(name, (generation, {}))
        assert held[name][0] == generation
        if kind == "line":
            assert start not in held[name][1]
            held[name][1][start] = raw
    return {name: sorted(lines.items()) for name, (_, lines) in held.items()}


def test_stream_follows_appends_cuts_and_replacements(spark, tmp_path):
    folder, out = tmp_path / "in", []
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"

    def check():
        drain(spark, folder, tmp_path, out)
        assert view(out) == {p.name: finished(p.read_bytes())[0] for p in folder.iterdir()} | {n: [] for n in view(out) if not (folder / n).exists()}

    a.write_bytes(b'{"k": 1}\n{"k": 2}\n{"hal')
    check()
    seen = len(out)
    check()
    assert len(out) == seen  # nothing new, nothing read
    with a.open("ab") as f:
        f.write(b'f": 3}\r')
    b.write_bytes(b"x\n" * 300)
    check()
    with a.open("ab") as f:
        f.write(b"\n{}\n")
    check()
    assert not [r for r in out if r[4] == "reset"]
    b.write_bytes(b"x\n" * 10)  # cut
    check()
    a.write_bytes(b'{"k": 9}\n' * 50)  # replaced by a longer one
    check()
    resets = [(os.path.basename(r[1]), r[2]) for r in out if r[4] == "reset"]
    assert resets == [("b.jsonl", 2), ("a.jsonl", 2)]
    b.unlink()
    check()
    b.write_bytes(b"back\n")
    check()
    assert [(os.path.basename(r[1]), r[2]) for r in out if r[4] == "reset"][2:] == [("b.jsonl", 3)]


def test_any_cut_of_the_bytes_gives_the_batch(spark, tmp_path):
    rng = random.Random(5)
    data = b"".join(json.dumps({"k": k, "t": "é" * (k % 9)}, ensure_ascii=False).encode() + rng.choice([b"\n", b"\r\n"]) for k in range(120))
    folder, out = tmp_path / "in", []
    folder.mkdir()
    path, at = folder / "s.jsonl", 0
    for cut in [*sorted(rng.sample(range(1, len(data)), 4)), len(data)]:
        with path.open("ab") as f:
            f.write(data[at:cut])
        at = cut
        drain(spark, folder, tmp_path, out, 64)
    batch = {(r["start"], r["raw"]) for r in growing.read(spark, f"file://{folder}").collect()}
    assert sorted(batch) == view(out)["s.jsonl"] == finished(data)[0] and len({r[0] for r in out}) == 5


def test_manifests_are_kept_for_some_batches_only(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "KEPT_MANIFESTS", 2)
    (tmp_path / "in").mkdir()
    reader = growing.GrowingStream({"path": f"file://{tmp_path}/in", "state": f"file://{tmp_path}/state"})
    start = reader.initialOffset()
    for k in range(6):
        (tmp_path / "in" / f"{k}.jsonl").write_text("{}\n")
        end = reader.latestOffset()
        assert [p.lower for p in reader.partitions(start, end)] == [0]
        reader.commit(end)
        start = end
    assert [p.name for p in sorted((tmp_path / "state").iterdir())] == ["000000000004.json", "000000000005.json", "000000000006.json"]
    with pytest.raises(ValueError):
        growing.GrowingStream({"path": "file:///x"})


def timed_lines(n, step=10):
    return "".join(json.dumps({"t": k * step, "k": k}) + "\n" for k in range(n))


def test_index_prunes_to_the_window(spark, tmp_path):
    folder, index = tmp_path / "in", f"file://{tmp_path}/index"
    folder.mkdir()
    (folder / "a.jsonl").write_text(timed_lines(400))
    (folder / "b.jsonl").write_text(timed_lines(50, 1) + '{"no": "time"}\n' + timed_lines(100, 1000))
    (folder / "c.jsonl").write_text(timed_lines(30))
    path, micros = f"file://{folder}", F.get_json_object("raw", "$.t").cast("long")
    growing.build_index(growing.read(spark, path), micros, index, block=256)

    def window(since, until):
        """What the index reads in the window, what a full read has there, and the bytes of both."""
        inside = lambda df: sorted((os.path.basename(r["path"]), r["start"], r["raw"]) for r in df.filter(micros.between(since, until)).collect())
        options = {"path": path, "rangeBytes": "256"}
        few = growing.GrowingReader(options | {"index": index, "since": str(since), "until": str(until)}).planned_bytes()
        got = inside(growing.read_window(spark, path, index, since, until, rangeBytes=256))
        assert got == inside(growing.read(spark, path))
        return len(got), few, growing.GrowingReader(options).planned_bytes()

    n, few, every = window(3000, 3100)
    assert n > 10 and few < every / 5
    assert window(10**9, 10**9 + 1)[0] == 0 and window(0, 10**9)[0] == 580
    with (folder / "a.jsonl").open("a") as f:
        f.write(timed_lines(3) + '{"t": 3050, "new": 1}\n{"t": 30')
    assert window(3000, 3100)[0] == n + 1  # gained since it was indexed
    whole = growing.read_window(spark, path, index, 0, 10**9, rangeBytes=256)
    assert whole.count() == whole.select("path", "start").distinct().count() == growing.read(spark, path).count()
    (folder / "c.jsonl").write_text('{"t": 3001}\n' + timed_lines(60))  # replaced
    (folder / "b.jsonl").write_text(timed_lines(8, 400))  # cut
    (folder / "a.jsonl").write_text(timed_lines(350) + '{"t": 3007}\n' * 90)  # replaced, but for its first line
    (folder / "d.jsonl").write_text('{"t": 3002}\n')  # not indexed
    assert window(3000, 3100)[0] > 10
    lines = growing.read_window(spark, path, index, 3000, 3100, rangeBytes=256)
    assert lines.count() == lines.select("path", "start").distinct().count()


def test_states_of_lines(spark):
    cases = {"{}": "ok", ' {"a": 1} ': "ok", '{"a": 1} x': "malformed", '{"a": 1}{}': "malformed", "{},{}": "malformed", "[1]": "non_object", "null": "non_object", "5": "non_object", "{": "malformed", "x": "malformed", " ": None, '{"a": NaN}': "malformed"}
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    assert {r[0]: r[1] for r in df.select("raw", growing.line_state(F.col("raw"))).collect()} == cases


def small_files(folder, n=300):
    """Files of some lines each, the last of them cut off; what is finished of every file."""
    folder.mkdir()
    for k in range(n):
        (folder / f"{k:03d}.jsonl").write_text(timed_lines(k % 4, 10 * (k + 1)) + '{"t": ')
    return {f"{k:03d}.jsonl": finished((folder / f"{k:03d}.jsonl").read_bytes())[0] for k in range(n)}


def test_small_files_share_tasks_and_are_not_opened_by_the_planner(spark, tmp_path, monkeypatch):
    want = small_files(tmp_path / "in")
    lines = growing.read(spark, f"file://{tmp_path}/in")
    assert lines.rdd.getNumPartitions() == 2  # 300 files
    got = {}
    for r in lines.collect():
        got.setdefault(os.path.basename(r["path"]), []).append((r["start"], r["raw"]))
    assert {name: sorted(got.get(name, [])) for name in want} == want
    monkeypatch.setattr(growing._Files, "open", None)
    options = {"path": f"file://{tmp_path}/in"}
    assert [len(p.parts) for p in growing.GrowingReader(options).partitions()] == [256, 44]
    assert len(growing.GrowingReader(options | {"rangeBytes": "100"}).partitions()) > 50
    monkeypatch.undo()
    stream = growing.GrowingStream(options | {"state": f"file://{tmp_path}/state"})
    assert len(stream.partitions(stream.initialOffset(), stream.latestOffset())) == 1  # files without a finished line have no range


def test_files_are_written_under_their_names(spark, tmp_path):
    rows = [(f"n{k % 7}.txt", k, None if k == 9 else "é" * (k % 5)) for k in range(100)] + [("one.txt", 0, "")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        growing.write_files(spark.createDataFrame(rows, "name string, k int, line string").repartition(2, "name").sortWithinPartitions("name", "k"), f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for name, _, line in rows:
        want[name] = want.get(name, "") + (line or "") + "\n"
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*/*")} == want


def test_files_of_users_without_an_id(spark, small, tmp_path):
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    (tmp_path / "events.parquet").unlink()
    events = spark.read.parquet(f"{small}/events.parquet")
    events.withColumn("user_id", F.when(F.col("user_id") > 2, F.col("user_id") - 9)).coalesce(1).toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    for name in ("session_files_by_range", "window_by_index"):
        assert differences(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], str(tmp_path)) == []


def test_window_over_small_files_shares_tasks(spark, tmp_path, monkeypatch):
    small_files(tmp_path / "in")
    (tmp_path / "in" / "long.jsonl").write_text(timed_lines(400))
    path, index, micros = f"file://{tmp_path}/in", f"file://{tmp_path}/index", F.get_json_object("raw", "$.t").cast("long")
    reads = []
    pieces = growing._Files.pieces
    growing.build_index(growing.read(spark, path), micros, index, block=64)
    lines = growing.read_window(spark, path, index, 100, 2000)
    assert lines.rdd.getNumPartitions() == 2
    inside = lambda df: sorted((os.path.basename(r["path"]), r["start"]) for r in df.filter(micros.between(100, 2000)).collect())
    assert inside(lines) == inside(growing.read(spark, path)) != []
    monkeypatch.setattr(growing._Files, "pieces", lambda *a: (reads.append(x) or x for x in pieces(*a)))
    growing.GrowingReader({"path": path, "index": index, "since": "100", "until": "2000"}).planned_bytes()
    assert len([x for x, _ in reads if x.path.endswith("long.jsonl") and x.upper > x.lower]) == 2  # the window's blocks together, and what follows the index
