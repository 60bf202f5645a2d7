"""Sum-of-squares online packing of documents into fixed windows.

A document longer than a window fills whole windows first; its rest goes to the
fill level that makes the sum of squared counts of partially filled windows
smallest.  The counts stand in a level array with one entry for each fill.
At the end of a partition the windows that are still open are drained: their
pieces are laid end to end and cut into full windows, so at most one window of
a partition stays partly filled.

Every partition packs its own rows in scan order: there is no shuffle, memory
is bounded by the open windows (at most one token buffer for each of them and
at most ``window`` levels), and a retried task gives the same sequences.

Defined results: null or empty text gives one piece holding the end id;
repeated rows and ids are packed separately; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loglattice.llm.tokens import TOKENIZER, encoded, ids_crc32

WINDOW = 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class LevelPacker:
    """Packs pieces ``(doc, start, doc_tokens, ids)``; :meth:`put` and :meth:`drain` return finished windows."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def _choose(self, size: int) -> int:
        """The level to fill; 0 opens a window.

        Moving a window from level h to h + size changes the sum of squares by
        2 (N[h + size] - N[h] + 1), where levels 0 and ``window`` count as
        nothing.
        """
        last = self.window - size
        cost = 2 * (self.levels[size : self.window + 1] - self.levels[: last + 1] + 1)
        cost[0] -= 1
        cost[last] -= 1
        cost[1:][self.levels[1 : last + 1] == 0] = np.iinfo(np.int64).max
        best = cost.min()
        return int(np.flatnonzero(cost == best)[-1])

    def put(self, doc: int | None, ids: np.ndarray) -> Iterator[list]:
        total, at = len(ids), 0
        while total - at >= self.window:
            yield [(doc, at, total, ids[at : at + self.window])]
            at += self.window
        if at == total:
            return
        size = total - at
        level = self._choose(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
        pieces.append((doc, at, total, ids[at:].copy()))
        level += size
        if level == self.window:
            yield pieces
        else:
            self.open.setdefault(level, []).append(pieces)
            self.levels[level] += 1

    def drain(self) -> Iterator[list]:
        held, room = [], self.window
        for level in sorted(self.open, reverse=True):
            for pieces in self.open[level]:
                for doc, start, total, ids in pieces:
                    while len(ids) > room:
                        held.append((doc, start, total, ids[:room]))
                        yield held
                        start, ids = start + room, ids[room:]
                        held, room = [], self.window
                    held.append((doc, start, total, ids))
                    room -= len(ids)
                    if not room:
                        yield held
                        held, room = [], self.window
        if held:
            yield held
        self.open, self.levels[:] = {}, 0


def pack(df: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document: where it starts in the document and where it lies in its sequence.

    ``sequence_id`` holds the partition in its upper bits and a counter in the
    lower 40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, rows = LevelPacker(window), TaskContext.get().partitionId() << 40, []
        made = 0

        def finished(windows: Iterator[list]) -> None:
            nonlocal made
            for pieces in windows:
                offset = 0
                for doc, start, total, ids in pieces:
                    rows.append((doc, start, len(ids), ids_crc32(ids), total, base + made, offset))
                    offset += len(ids)
                made += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 7)], schema=_FIELDS)
            rows.clear()
            return batch

        for doc, ids in encoded(batches, tokenizer, end_id):
            finished(packer.put(doc, ids))
            if len(rows) >= 20_000:
                yield flush()
        finished(packer.drain())
        yield flush()

    return df.select(df["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
