"""Substring dedup with fixed-block anchors.

A passage of ``window`` words that stands in two places is removed from both.  Of
the window's length and one more, half is the length of an anchor: every text is
cut into non-overlapping blocks of that many words, which are the index, and any
window of a text holds one of them whole.  So each of two equal windows finds an
anchor of the other when every rolling window of the anchor's length is probed;
a probe that meets an anchor in another place than its own is a hit.  Hits are
extended as far as the words agree: every window that holds a hit is looked up by
all its words, a window found in two places marks its words, and runs of marked
words are the maximal repeats.

No task holds the index, and no pair of places is ever made.  A task cuts its
documents into blocks of bounded size; a block sends its distinct anchors and
probes, as sorted keys packed in arrays, to the shards of the key's range, which
count anchors (one, or more) and answer each block with two bits a probe.  The
block's documents, packed in one row, meet the answers, and windows that hold a
hit are counted the same way.  A passage that a third of all documents share is
thus one entry for each block.  Documents without a hit are finished in the second
step; only the others are carried to the third.

Keys of anchors have some bits more than the number of words needs, so chance hits
are rare, and they only cost a lookup; windows are told apart by 64-bit hash.

Defined results: null or blank text has no words; shorter texts than a window lose
nothing; a null id passes through; repeated rows are places of their own and repeat
one another; other columns are not read; an empty table gives no row.  ``df`` is
read twice; if the readings differ, the job fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm import lm, storage
from loglattice.llm.textkit import POWERS, hashed_rows, mix64, string_buffers

WINDOW = 35
BLOCK_BYTES = 8 << 20
#: Text for each shard of anchors, which are held together while probes stream by, and of windows, which are counted together.
ANCHOR_SHARD, WINDOW_SHARD = 2 << 30, 64 << 20
#: Bits of an anchor's key beyond those that number the corpus's words.
MORE_BITS = 12

_ASKED = "block long, shard long, probe boolean, size long, first long, steps binary, twice binary"
_ANSWERED = "block long, shard long, size long, bits binary"
_STEP = f"kind int, {_ASKED}, docs binary, marks binary, doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = ("doc_id", "n_words", "n_removed", "spans", "text")
_KINDS = {
    "kind": pa.int32(), "block": pa.int64(), "shard": pa.int64(), "probe": pa.bool_(), "size": pa.int64(), "first": pa.int64(), "steps": pa.binary(), "twice": pa.binary(), "bits": pa.binary(),
    "docs": pa.binary(), "marks": pa.binary(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": _SPANS, "text": pa.string(),
}


def window_keys(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a window of ``length`` words starts within one text, and its hash."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = POWERS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    places = np.flatnonzero(np.arange(n) + length <= ends)
    return places, mix64((sums[places + length] - sums[places]) * down[places] + np.uint64(length))


def _bits(marks: np.ndarray) -> bytes:
    return np.packbits(marks).tobytes()


def _marks(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def _messages(number: int, keys: np.ndarray, shards: int, width: int, probe: bool, twice: np.ndarray | None) -> Iterator[dict]:
    """Sorted keys of ``width`` bits, packed for each shard; shards are ranges of the key."""
    edges = np.array([-(-(s << width) // shards) for s in range(shards)], dtype=np.uint64)
    cuts = np.r_[np.searchsorted(keys, edges), len(keys)]
    for s in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[s], cuts[s + 1]
        steps = lm.packed(np.diff(keys[a:b]))
        yield {"block": number, "shard": int(s), "probe": probe, "size": int(b - a), "first": int(keys[a]) - (1 << 63), "steps": steps, "twice": None if twice is None else _bits(twice[a:b])}


def _keys(message: dict) -> np.ndarray:
    steps = lm.unpacked(message["steps"], message["size"] - 1)
    return np.cumsum(np.r_[np.uint64(message["first"] + (1 << 63)), steps], dtype=np.uint64)


def _rows(rows: list[dict], columns: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in columns.replace("array<struct<start:long,end:long>>", "spans").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _KINDS[c]) for c in names], names=names)


class Block:
    """Words of a block of documents, their anchors and their rolling windows."""

    def __init__(self, text: pa.Array, window: int) -> None:
        self.window, self.anchor = window, (window + 1) // 2
        self.words, self.bounds = hashed_rows(text, lower=False)

    def probes(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of rolling windows, their keys, and which of them are anchors."""
        places, keys = window_keys(self.words, self.bounds, self.anchor)
        begins = np.repeat(self.bounds[:-1], np.diff(self.bounds))
        return places, keys >> np.uint64(64 - width), (places - begins[places]) % self.anchor == 0

    def holding(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the windows that hold one of the rolling windows at ``hits``."""
        places, keys = window_keys(self.words, self.bounds, self.window)
        upto = np.zeros(len(self.words) + 1, dtype=np.int64)
        upto[hits + 1] = 1
        upto = np.cumsum(upto)
        some = upto[places + self.window - self.anchor + 1] > upto[places]
        return places[some], keys[some]


def _ask(window: int, shards: int, width: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, docs in lm.blocks(batches, limit):
            _, keys, fixed = Block(docs.column("text").combine_chunks(), window).probes(width)
            anchors, counts = np.unique(keys[fixed], return_counts=True)
            rows = [*_messages(number, anchors, shards, width, False, counts > 1), *_messages(number, np.unique(keys), shards, width, True, None)]
            yield _rows(rows, _ASKED)

    return run


def _count(messages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and whether they stand in two places or more."""
    keys = np.concatenate([k for k, _ in messages])
    every, index = np.unique(keys, return_inverse=True)
    return every, np.bincount(index, weights=1 + np.concatenate([t for _, t in messages])) > 1


def _found(every: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(every, keys), max(0, len(every) - 1))
    return at, every[at] == keys if len(every) else np.zeros(len(keys), dtype=bool)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers probes; a shard's anchors come before its probes."""
    shard, held, index = None, [], None
    for batch in batches:
        out = []
        for message in batch.to_pylist():
            if message["shard"] != shard:
                shard, held, index = message["shard"], [], None
            if not message["probe"]:
                held.append((_keys(message), _marks(message["twice"], message["size"])))
                continue
            if index is None:
                index, held = _count(held) if held else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)), []
            at, some = _found(index[0], _keys(message))
            more = some & index[1][at] if len(index[0]) else some
            out.append({c: message[c] for c in ("block", "shard", "size")} | {"bits": _bits(some) + _bits(more)})
        yield _rows(out, _ANSWERED)


def _repeated(asked: pa.Table) -> pa.Table:
    """Answers which of the windows of each block stand in two places."""
    messages = asked.to_pylist()
    keys = [_keys(m) for m in messages]
    every, twice = _count([(k, _marks(m["twice"], m["size"])) for k, m in zip(keys, messages, strict=True)])
    rows = [{c: m[c] for c in ("block", "shard", "size")} | {"bits": _bits(twice[np.searchsorted(every, k)])} for k, m in zip(keys, messages, strict=True)]
    return pa.Table.from_batches([_rows(rows, _ANSWERED)])


def _answers(got: pa.Table, parts: int) -> list[np.ndarray]:
    """The bits of a block's answers, in the order of its sorted keys."""
    out: list[list[np.ndarray]] = [[] for _ in range(parts)]
    for _, size, bits in sorted(zip(*(got.column(c).to_pylist() for c in ("shard", "size", "bits")), strict=True)):
        step = len(bits) // parts
        for k in range(parts):
            out[k].append(_marks(bits[k * step : (k + 1) * step], size))
    return [np.concatenate(x) if x else np.zeros(0, dtype=bool) for x in out]


def _documents(kept: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(kept.column("docs")[0].as_buffer()).read_all()


def _finished(docs: pa.Table, bounds: np.ndarray, covered: np.ndarray, digest: bool) -> Iterator[dict]:
    """Result rows of documents whose ``covered`` words go."""
    texts = docs.column("text").combine_chunks()
    raw, offsets = string_buffers(texts)
    for k, doc_id in enumerate(docs.column("doc_id").to_pylist()):
        gone, own = covered[bounds[k] : bounds[k + 1]], raw[offsets[k] : offsets[k + 1]].tobytes().split()
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
        if edges:
            own = [own[i] for i in np.flatnonzero(~gone)]
        text = b" ".join(own)
        spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        yield {"kind": 0, "doc_id": doc_id, "n_words": len(gone), "n_removed": int(gone.sum()), "spans": spans, "text": hashlib.sha256(text).hexdigest() if digest else text.decode()}


def remove_repeats(df: DataFrame, window: int = WINDOW, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed``, the ``spans`` of removed words (numbers, end exclusive) and the ``text`` of those left, joined by a space.

    With ``digest``, ``text`` holds the SHA-256 of that text, in hexadecimal digits, and no text is written on the way.
    """
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = storage.workers(spark)
    tasks, width = max(least, -(-total // (2 * block_bytes))), min(64, total.bit_length() + MORE_BITS)
    shards, window_shards = max(least, -(-total // ANCHOR_SHARD)), max(least, -(-total // WINDOW_SHARD))

    def second(kept: pa.Table, got: pa.Table) -> pa.Table:
        if kept.num_rows != 1:
            raise RuntimeError("two readings of the documents differ")
        number, docs = kept.column("block")[0].as_py(), _documents(kept)
        block = Block(docs.column("text").combine_chunks(), window)
        places, keys, fixed = block.probes(width)
        _, index = np.unique(keys, return_inverse=True)
        some, more = _answers(got, 2)
        if len(places) and (not len(index) or int(index.max()) + 1 != len(some)):
            raise RuntimeError("two readings of the documents differ")
        hits = places[np.where(fixed, more[index], some[index])] if len(places) else places
        starts, keys = block.holding(hits)
        distinct, counts = np.unique(keys, return_counts=True)
        rows = [{"kind": 1, **m} for m in _messages(number, distinct, window_shards, 64, False, counts > 1)]
        holds = np.zeros(len(block.bounds) - 1, dtype=bool)
        holds[np.searchsorted(block.bounds, starts, side="right") - 1] = True
        carried = np.flatnonzero(holds)
        if len(carried):
            marks = np.zeros(len(block.words), dtype=bool)
            marks[starts] = True
            sizes = np.diff(block.bounds)
            rows.append({"kind": 2, "block": number, "docs": lm.packed_documents(docs.take(pa.array(carried))), "marks": _bits(marks[np.repeat(holds, sizes)])})
        left = np.flatnonzero(~holds)
        bounds = np.r_[0, np.cumsum(np.diff(block.bounds)[left])]
        rows += _finished(docs.take(pa.array(left)), bounds, np.zeros(bounds[-1], dtype=bool), digest)
        return pa.Table.from_batches([_rows(rows, _STEP)])

    def third(kept: pa.Table, got: pa.Table) -> pa.Table:
        docs = _documents(kept)
        block = Block(docs.column("text").combine_chunks(), window)
        places, keys = window_keys(block.words, block.bounds, window)
        chosen = _marks(kept.column("marks")[0].as_py(), len(block.words))[places]
        places, keys = places[chosen], keys[chosen]
        _, index = np.unique(keys, return_inverse=True)
        places = places[_answers(got, 1)[0][index]]
        depth = np.zeros(len(block.words) + 1, dtype=np.int64)
        np.add.at(depth, places, 1)
        np.add.at(depth, places + window, -1)
        rows = list(_finished(docs, block.bounds, np.cumsum(depth[:-1]) > 0, digest))
        return pa.Table.from_batches([_rows(rows, _STEP)]).select(list(_RESULT))

    with storage.small_arrow_batches(spark):
        asked = rows.mapInArrow(_ask(window, shards, width, block_bytes), _ASKED).repartition(max(least, shards), "shard").sortWithinPartitions("shard", "probe")
        answers = asked.mapInArrow(_meet, _ANSWERED).repartition(tasks, "block")
        kept = rows.mapInArrow(lm.kept_blocks(block_bytes), "block long, docs binary").repartition(tasks, "block")
        step = storage.settle(kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(second, _STEP), "repeat-windows")
        found = step.filter("kind = 1").select(*[c.split()[0] for c in _ASKED.split(", ")]).repartition(max(least, window_shards), "shard").groupBy("shard").applyInArrow(_repeated, _ANSWERED)
        carried = step.filter("kind = 2").select("block", "docs", "marks").repartition(tasks, "block")
        result = ", ".join(x for x in _STEP.split(", ") if x.split()[0] in _RESULT)
        last = carried.groupBy("block").cogroup(found.repartition(tasks, "block").groupBy("block")).applyInArrow(third, result)
        return step.filter("kind = 0").select(*_RESULT).unionByName(last)
