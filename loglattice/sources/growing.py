"""A data source for session files that grow while they are read: ``growing_lines``.

Batch and stream give the same rows: ``path, generation, start, kind, raw``, where
``start`` is the byte at which a line begins.  Lines end as ``bytes.splitlines`` ends
them; what follows the last end, and a carriage return that a line feed may still
follow, is held back.  A file is cut into byte ranges of ``rangeBytes``; a range owns
the lines that begin in it, so one large file is read by many tasks, and no task or
driver holds a file whole.  Ranges of small files are read by one task until they have
``rangeBytes`` or ``FILES`` together.

A stream's offset is the number of a manifest in the folder of the option ``state``.
A manifest has, for each file, its generation, the bytes read so far, a checksum of
its head and one of its last line.  If a file is shorter than what was read, or one
of the checksums differs, it was replaced: its generation goes up by one, a row of
kind ``reset`` comes before its lines, and it is read from the start.  A file that
goes away gives a ``reset`` row only.  The planner reads some kilobytes of a file
whose size or time has changed, and nothing of the others.

The planner of a batch only lists files that are no longer than a range; where their
lines end is found by the tasks that read them, from the size that was listed.

A sidecar index (:func:`build_index`) has the least and greatest time of every block of
bytes.  A batch read with the options ``index``, ``since`` and ``until`` (microseconds,
both ends belong to the window) reads the blocks whose times meet the window, blocks
without a time, and what a file has gained since it was indexed; a file that is shorter
than its index, or whose first or last indexed line differs, is read whole.

Options: ``path`` (a folder or file, any file system that Arrow knows), ``pattern``
(names, ``*.jsonl``), ``rangeBytes``, ``state`` (streams only).  An empty folder gives
no rows, bytes that are no UTF-8 become replacement characters, equal lines stay.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loglattice.operators.ordered import running_sum
from loglattice.sources.shared import settle

SCHEMA = "path string, generation long, start long, kind string, raw string"
RANGE_BYTES = 32 << 20
HEAD_BYTES = 4 << 10
#: Bytes read at once.
CHUNK = 1 << 20
#: Ranges of small files that one task reads.
FILES = 256
#: Manifests kept behind the last committed one, for batches that run again.
KEPT_MANIFESTS = 16


def last_line_end(data: bytes) -> int:
    """Bytes of ``data`` up to the last end of a line that is certain; 0 if none is."""
    feed = data.rfind(b"\n") + 1
    back = data.rfind(b"\r", feed, len(data) - 1) + 1
    return max(feed, back)


def _read(handle, start: int, end: int) -> bytes:
    handle.seek(start)
    return handle.read(max(0, end - start))


def committed_end(handle, size: int) -> int:
    """Where the finished lines of a file end, found backwards from its end."""
    at, tail = size, b""
    while at > 0:
        before = max(0, at - CHUNK)
        tail = _read(handle, before, at) + tail[:1]  # one byte more, for a carriage return at the seam
        if end := last_line_end(tail):
            return before + end
        at = before
    return 0


def last_line_start(handle, end: int) -> int:
    """Where the last finished line before ``end`` begins."""
    at, tail = end, b""
    while at > 0:
        before = max(0, at - CHUNK)
        tail = _read(handle, before, at) + tail
        body = tail[:-2] if tail.endswith(b"\r\n") else tail[:-1]
        if start := max(body.rfind(b"\n"), body.rfind(b"\r")) + 1:
            return before + start
        at = before
    return 0


def lines_between(handle, lower: int, upper: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``start, line`` of the lines that begin in ``[lower, upper)``; ``end`` is where the file's finished lines end."""
    at = place = max(0, lower - 1)  # the byte before tells whether a line begins at ``lower``
    held, beyond = b"", HEAD_BYTES
    while at < end:
        chunk = _read(handle, at, min(end, at + CHUNK, max(upper, at + beyond)))
        if not chunk:
            raise OSError("a file became shorter while it was read")
        if at >= upper:  # the rest of the last line, in steps that grow
            beyond *= 2
        at += len(chunk)
        lines = (held + chunk).splitlines(keepends=True)
        held = lines.pop() if at < end and not lines[-1].endswith(b"\n") else b""
        for line in lines:
            start, place = place, place + len(line)
            if start >= upper:
                return
            if start >= lower:
                yield start, line


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@dataclass(frozen=True)
class Range(InputPartition):
    """Lines of one file that begin in ``[lower, upper)``; a reset row first if ``reset``."""

    path: str
    generation: int
    lower: int
    upper: int
    end: int
    reset: bool = False


@dataclass(frozen=True)
class Indexed:
    """What an index holds of a file: where its last line ends it, checksums of its first and last line, and spans of blocks that a window may need."""

    upper: int
    head: str
    tail: str
    spans: list[tuple[int, int]] = field(default_factory=list)


@dataclass(frozen=True)
class Small(InputPartition):
    """A file no longer than a range; the task that reads it finds its ranges."""

    path: str
    size: int
    indexed: Indexed | None


@dataclass(frozen=True)
class Bundle(InputPartition):
    """What one task reads, one after another."""

    parts: list[Range | Small]


@dataclass
class Known:
    """What a manifest holds of a file."""

    generation: int
    size: int
    changed: int
    end: int
    line: int
    head_bytes: int
    head: str
    boundary: str


class _Files:
    """Listing and reading of session files."""

    def __init__(self, options: dict[str, str]) -> None:
        self.where = options["path"]
        self.pattern = options.get("pattern", "*.jsonl")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.where)

    def listed(self) -> dict[str, tuple[int, int]]:
        """Size and time of change of every file, by its path."""
        system, top = self._system()
        if system.get_file_info(top).type == fs.FileType.File:
            infos = [system.get_file_info(top)]
        else:
            infos = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        return {x.path: (x.size, x.mtime_ns or 0) for x in infos if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.pattern)}

    def open(self, path: str):
        return self._system()[0].open_input_file(path)

    def ranges(self, path: str, generation: int, start: int, stop: int, reset: bool = False, end: int | None = None) -> list[Range]:
        """Ranges of ``[start, stop)``; ``end``, if the file's finished lines end elsewhere than at ``stop``."""
        end = stop if end is None else end
        cuts = [*range(start, stop, self.range_bytes), stop]
        found = [Range(path, generation, a, b, end, reset and a == start) for a, b in zip(cuts, cuts[1:], strict=False)]
        return found or ([Range(path, generation, start, start, start, True)] if reset else [])

    def now(self, path: str, handle, size: int, indexed: Indexed | None) -> list[Range]:
        """Ranges of a file's finished lines, of an indexed one those that the window may need and those after the indexed ones."""
        end = committed_end(handle, size)
        if indexed is None or end < indexed.upper:
            return self.ranges(path, 1, 0, end)
        for at, told in ((0, indexed.head), (indexed.upper - 1, indexed.tail)):
            start, line = next(lines_between(handle, at, at + 1, end), (-1, b""))
            if start != at or _sha(line.rstrip(b"\r\n").decode("utf-8", "replace").encode()) != told:
                return self.ranges(path, 1, 0, end)
        # The index ends with the beginning of its last line; lines after that one are new.
        joined: list[list[int]] = []
        for lower, upper in [*((a, min(b, indexed.upper)) for a, b in sorted(indexed.spans)), (indexed.upper, end)]:
            if joined and joined[-1][1] == lower:
                joined[-1][1] = upper
            else:
                joined.append([lower, upper])
        return [x for lower, upper in joined for x in self.ranges(path, 1, lower, upper, end=end)]

    def bundled(self, parts: list[Range | Small]) -> list[Range | Small | Bundle]:
        """``parts`` put together to tasks."""
        held: list[list[Range | Small]] = []
        full, files = 0, 0
        for part in parts:
            n = part.size if isinstance(part, Small) else part.upper - part.lower
            if not held or full + n > self.range_bytes or files == FILES:
                held.append([])
                full, files = 0, 0
            held[-1].append(part)
            full, files = full + n, files + 1
        return [x[0] if len(x) == 1 else Bundle(x) for x in held]

    def pieces(self, part: Range | Small | Bundle, system: fs.FileSystem) -> Iterator[tuple[Range, object]]:
        """Ranges of ``part``, each with its file; none is opened for a range without bytes."""
        for one in part.parts if isinstance(part, Bundle) else [part]:
            if isinstance(one, Range) and one.upper <= one.lower:
                yield one, None
                continue
            with system.open_input_file(one.path) as handle:
                if isinstance(one, Range):
                    yield one, handle
                    continue
                if one.size <= CHUNK:  # read at once
                    data = _read(handle, 0, one.size)
                    if len(data) < one.size:
                        raise OSError("a file became shorter while it was read")
                    held = io.BytesIO(data)
                else:
                    held = handle
                for found in self.now(one.path, held, one.size, one.indexed):
                    yield found, held

    def rows(self, part: Range | Small | Bundle | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing to read
            return
        names, kinds = ["path", "generation", "start", "kind", "raw"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for piece, handle in self.pieces(part, self._system()[0]):
            path, generation = piece.path, piece.generation
            if piece.reset:
                rows.append((path, generation, -1, "reset", None))
            if handle is None:
                continue
            for start, line in lines_between(handle, piece.lower, piece.upper, piece.end):
                rows.append((path, generation, start, "line", line.rstrip(b"\r\n").decode("utf-8", "replace")))
                size += len(line) + len(path)
                if size >= CHUNK:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class GrowingReader(DataSourceReader):
    """All finished lines, at the moment of planning; with an index those of a window of time, and their neighbours in a block."""

    def __init__(self, options: dict[str, str]) -> None:
        self.files = _Files(options)
        self.index, self.since, self.until = options.get("index"), int(options.get("since", -(1 << 62))), int(options.get("until", 1 << 62))

    def _indexed(self) -> dict[str, Indexed]:
        """Indexed files, with the blocks that the window may need."""
        system, top = fs.FileSystem.from_uri(self.index)
        held = pyarrow.dataset.dataset(top, filesystem=system, format="parquet")
        blocks = (pc.field("kind") == "block") & (pc.is_null(pc.field("lowest")) | ((pc.field("lowest") <= self.until) & (pc.field("highest") >= self.since)))
        columns = lambda names, wanted: zip(*[c.to_pylist() for c in held.to_table(names, filter=wanted).columns], strict=True)
        found = {path: Indexed(upper, head, tail) for path, upper, head, tail in columns(["path", "upper", "head", "tail"], pc.field("kind") == "file")}
        for path, lower, upper in columns(["path", "lower", "upper"], blocks):
            found[path].spans.append((lower, upper))
        return found

    def partitions(self) -> list[Range | Small | Bundle]:
        found, known = [], self._indexed() if self.index else {}
        for path, (size, _) in sorted(self.files.listed().items()):
            if size > self.files.range_bytes:
                with self.files.open(path) as handle:
                    found += self.files.now(path, handle, size, known.get(path))
            elif size:
                found.append(Small(path, size, known.get(path)))
        return self.files.bundled(found)

    def planned_bytes(self) -> int:
        """Bytes that the plan's ranges have together."""
        system = fs.FileSystem.from_uri(self.files.where)[0]
        return sum(piece.upper - piece.lower for part in self.partitions() for piece, _ in self.files.pieces(part, system))

    def read(self, partition: Range | Small | Bundle) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class GrowingStream(DataSourceStreamReader):
    """Lines that were finished since the batch before, and resets of files that were replaced."""

    def __init__(self, options: dict[str, str]) -> None:
        if "state" not in options:
            raise ValueError("a stream of growing lines needs the option 'state', a folder that outlives the driver")
        self.files = _Files(options)
        self.state = options["state"]

    # -- manifests ---------------------------------------------------------

    def _numbers(self) -> list[int]:
        system, top = fs.FileSystem.from_uri(self.state)
        infos = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return sorted(int(x.base_name.split(".")[0]) for x in infos if x.base_name.endswith(".json"))

    def _load(self, number: int) -> dict[str, Known]:
        if number <= 0:
            return {}
        system, top = fs.FileSystem.from_uri(self.state)
        with system.open_input_file(f"{top}/{number:012d}.json") as handle:
            return {path: Known(**known) for path, known in json.loads(handle.read()).items()}

    def _store(self, number: int, files: dict[str, Known]) -> None:
        system, top = fs.FileSystem.from_uri(self.state)
        system.create_dir(top, recursive=True)
        with system.open_output_stream(f"{top}/{number:012d}.part") as out:
            out.write(json.dumps({path: asdict(known) for path, known in files.items()}).encode())
        system.move(f"{top}/{number:012d}.part", f"{top}/{number:012d}.json")

    # -- what has changed --------------------------------------------------

    def _look(self, path: str, size: int, changed: int, before: Known | None) -> Known:
        """A file's entry now; the generation goes up if what was read of it is no longer there."""
        with self.files.open(path) as handle:
            generation, start = 1, 0
            if before is not None:
                same = size >= before.end and _sha(_read(handle, 0, before.head_bytes)) == before.head and _sha(_read(handle, before.line, before.end)) == before.boundary
                generation, start = (before.generation, before.end) if same else (before.generation + 1, 0)
            end = committed_end(handle, size)
            if end <= start and generation == (before.generation if before else 1):
                end = start
            line = last_line_start(handle, end)
            head = min(HEAD_BYTES, end)
            return Known(generation, size, changed, end, line, head, _sha(_read(handle, 0, head)), _sha(_read(handle, line, end)))

    def initialOffset(self) -> dict:
        return {"manifest": 0}

    def latestOffset(self) -> dict:
        number = max(self._numbers(), default=0)
        before, now = self._load(number), {}
        listed = self.files.listed()
        for path, (size, changed) in listed.items():
            known = before.get(path)
            now[path] = known if known and (known.size, known.changed) == (size, changed) else self._look(path, size, changed, known)
        for path, known in before.items():
            if path not in listed:
                gone = known.size < 0
                now[path] = known if gone else Known(known.generation + 1, -1, 0, 0, 0, 0, _sha(b""), _sha(b""))
        if now != before:
            number += 1
            self._store(number, now)
        return {"manifest": number}

    def partitions(self, start: dict, end: dict) -> list[Range | Small | Bundle]:
        before, now, found = self._load(start["manifest"]), self._load(end["manifest"]), []
        for path, known in sorted(now.items()):
            old = before.get(path)
            if old is None or old.generation == known.generation:
                found += self.files.ranges(path, known.generation, old.end if old else 0, known.end, old is None and known.generation > 1)
            else:
                found += self.files.ranges(path, known.generation, 0, known.end, True)
        return self.files.bundled(found)

    def read(self, partition: Range | Small | Bundle) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)

    def commit(self, end: dict) -> None:
        system, top = fs.FileSystem.from_uri(self.state)
        for number in self._numbers():
            if number < end["manifest"] - KEPT_MANIFESTS:
                system.delete_file(f"{top}/{number:012d}.json")


class GrowingLines(DataSource):
    """The data source by its short name."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GrowingReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingStream(dict(self.options))


def read(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The finished lines below ``path`` now."""
    spark.dataSource.register(GrowingLines)
    return spark.read.format("growing_lines").options(**options).load(path)


def follow(spark: SparkSession, path: str, state: str, **options: str | int) -> DataFrame:
    """A stream of the lines below ``path``; ``state`` is a folder for its manifests."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(state=state, **options).load(path)


def write_files(lines: DataFrame, folder: str) -> None:
    """Writes ``lines(name, line)`` to a file for each name; rows of a name lie in one partition, one after another.

    Spark's own writer takes some 16 ms a file on a local disk.  A file gets its name when it is finished; a task that fails leaves at most one under another name.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        place, attempt = f"{top}/{context.partitionId():05d}", context.taskAttemptId()
        held, out = None, None

        def finish() -> None:
            if out is not None:
                out.close()
                system.move(f"{place}/{held}.{attempt}", f"{place}/{held}")

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(0))
            ends = runs.run_ends.to_pylist()
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), batch.column(1).cast(pa.string()).fill_null("")), "\n")
            for name, text in zip(runs.values.to_pylist(), texts, strict=True):
                if name != held:
                    finish()
                    if held is None:
                        system.create_dir(place, recursive=True)
                    held, out = name, system.open_output_stream(f"{place}/{name}.{attempt}")
                out.write(text.as_buffer())
                out.write(b"\n")
        finish()
        yield from ()

    lines.select("name", "line").mapInArrow(write, "none int").write.format("noop").mode("overwrite").save()


def build_index(lines: DataFrame, micros: Column, folder: str, block: int = RANGE_BYTES) -> None:
    """Writes the index of ``lines`` to ``folder``; ``micros`` is a line's time, null if it has none.

    One row for each block of bytes in which lines begin, and one for each file with where its last line begins and checksums of its first and last.
    """
    timed = lines.filter("kind = 'line'").withColumn("t", micros)
    # Both kinds of rows come from the blocks, so the files are read once.
    blocks = settle(timed.groupBy("path", F.floor(F.col("start") / block).alias("b")).agg(
        F.min("t").alias("lowest"), F.max("t").alias("highest"), F.count(F.lit(1)).alias("n"), F.count("t").alias("timed"),
        F.max("start").alias("last"), F.sha2(F.min_by("raw", "start"), 256).alias("head"), F.sha2(F.max_by("raw", "start"), 256).alias("tail"),
    ), "index-blocks")
    # A block that holds a line without a time is always read.
    sometimes = lambda c: F.when(F.col("n") == F.col("timed"), F.col(c)).alias(c)
    none = F.lit(None).cast("long")
    rows = blocks.select("path", F.lit("block").alias("kind"), (F.col("b") * block).alias("lower"), ((F.col("b") + 1) * block).alias("upper"), sometimes("lowest"), sometimes("highest"), *[F.lit(None).cast("string").alias(c) for c in ("head", "tail")])
    files = blocks.groupBy("path").agg(F.max("last").alias("last"), F.min_by("head", "b").alias("head"), F.max_by("tail", "b").alias("tail"))
    whole = files.select("path", F.lit("file").alias("kind"), F.lit(0).cast("long").alias("lower"), (F.col("last") + 1).alias("upper"), none.alias("lowest"), none.alias("highest"), "head", "tail")
    rows.unionByName(whole).write.mode("overwrite").parquet(folder)


def read_window(spark: SparkSession, path: str, index: str, since: int, until: int, **options: str | int) -> DataFrame:
    """Lines below ``path`` that may lie within the window; the caller filters by time, as without an index."""
    return read(spark, path, index=index, since=since, until=until, **options)


def numbered(lines: DataFrame, bucket: int = RANGE_BYTES) -> DataFrame:
    """``lines`` with ``pos``, the line's number in its file from 1, counted in buckets of ``bucket`` bytes."""
    return running_sum(lines.filter("kind = 'line'"), ["path", "generation"], "start", F.lit(1), "pos", bucket)


def line_state(raw: Column) -> Column:
    """``ok``, ``malformed`` or ``non_object``; null for a blank line.

    Spark's parser stops after the first value, so it is given a list: what follows the value breaks that.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    value = F.try_variant_get(listed, "$[0]", "variant")
    single = value.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    state = F.when(~single, "malformed").when(~F.schema_of_variant(value).startswith("OBJECT"), "non_object").otherwise("ok")
    return F.when(F.trim(raw) != "", state)
