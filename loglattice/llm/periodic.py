"""Periodic runs of words, found on a harmonic grid.

A run is a stretch of consecutive words with smallest period q that is at least
four periods (and six words) long and that no neighbouring word extends.  For each
period p the words at 0, p, 2p, ... form a grid; a run of period p holds at least
four neighbouring grid points, so the longest common extensions, forward and
backward, of the points jp and (j+1)p give its two ends.  Extensions are minima
over the common-prefix array of a suffix array (of the words) and of a second one
(of the words reversed), answered in constant time from a sparse table.  All grids
of a text have n log n points together.  A point is asked about only if it has the
same word as the three points after it, and suffix arrays are built only for the
texts that have such points; both leave out nothing that could be part of a run.

A stretch that is a run of period p is found for multiples of p too; the smallest
period of equal stretches is the run's.  Texts are worked on where they are read,
several at once in numpy arrays, without a shuffle; a text larger than a batch
stands alone.  Words are compared within one text by 64-bit hash.

Defined results: null or blank text has no words, no runs and an empty collapsed
text; a null id passes through; repeated rows are reported each; other columns are
not read; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.textkit import hashed_rows, small_batches, string_buffers

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Grid points looked at together.
POINTS = 1 << 21
BATCH_BYTES = 2 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Suffixes:
    """Suffix array of whole numbers with its common-prefix array and a sparse table of minima over it."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        ordered = np.sort(symbols)
        levels, width = [np.searchsorted(ordered, symbols).astype(np.int32)], 1
        while True:
            rank = levels[-1]
            tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(tied):
                break
            after = tied + width
            second = np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            key = rank[tied].astype(np.int64) * (n + 1) + second
            order = np.argsort(key)
            key, group = key[order], rank[tied][order]
            step = np.arange(len(key))
            same = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], step, 0))
            first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], step, 0))
            finer = rank.copy()
            finer[tied[order]] = group + (same - first)
            levels.append(finer)
            width *= 2
        self.rank = levels[-1]
        places = np.empty(n, dtype=np.int64)
        places[self.rank] = np.arange(n)
        self.table = self._minima(self._prefixes(places, levels[:-1]))

    @staticmethod
    def _prefixes(places: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Length of the common prefix of each suffix and the one before it in order; equal ranks on level k mean 2^k equal symbols."""
        n = len(places)
        a, b = places[:-1].copy(), places[1:].copy()
        shared = np.zeros(max(0, n - 1), dtype=np.int32)
        for k in range(len(levels) - 1, -1, -1):
            equal = (a < n) & (b < n)
            equal &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
            for x in (a, b, shared):
                x[equal] += 1 << k
        return np.r_[np.int32(0), shared].astype(np.int32)

    @staticmethod
    def _minima(row: np.ndarray) -> np.ndarray:
        rows, width = [row], 1
        while 2 * width <= len(row):
            last, half = rows[-1], len(row) - 2 * width + 1
            least = last.copy()
            least[:half] = np.minimum(last[:half], last[width : width + half])
            rows.append(least)
            width *= 2
        return np.stack(rows)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, which differ; 0 at the end of the array."""
        n = len(self.rank)
        inside = (i < n) & (j < n)
        a, b = self.rank[np.minimum(i, n - 1)], self.rank[np.minimum(j, n - 1)]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        low = np.minimum(low, high)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.where(inside, np.minimum(self.table[level, low], self.table[level, high - (1 << level) + 1]), 0).astype(np.int64)


def grid_points(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``place, period`` of the grid points whose next three points have the same word, for every period of every text."""
    sizes = np.diff(bounds)
    periods = np.where(sizes >= LEAST_WORDS, sizes // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    points = (sizes[text] - 1) // period - (LEAST_PERIODS - 2)
    upto, at = np.cumsum(points), 0
    while at < len(points):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - points[at] + POINTS, side="right")))
        few = points[at:to]
        step = np.repeat(period[at:to], few)
        place = (np.arange(len(step)) - np.repeat(np.cumsum(few) - few, few)) * step + np.repeat(bounds[text[at:to]], few)
        for k in range(1, LEAST_PERIODS):
            equal = words[place] == words[place + k * step]
            place, step = place[equal], step[equal]
        if len(place):
            yield place, step
        at = to


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of every run of the texts within ``bounds``, by start (counted over all texts), then period."""
    found = list(grid_points(words, bounds))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    place, period = (np.concatenate(x) for x in zip(*found, strict=True))
    sizes = np.diff(bounds)
    owner = np.searchsorted(bounds, place, side="right") - 1
    chosen = np.unique(owner)
    begins = np.cumsum(sizes[chosen]) - sizes[chosen]  # in the array of the chosen texts only
    inside = np.repeat(bounds[chosen] - begins, sizes[chosen]) + np.arange(sizes[chosen].sum())
    _, symbols = np.unique(words[inside], return_inverse=True)
    symbols = symbols + np.repeat(np.arange(len(chosen)), sizes[chosen]) * (int(symbols.max()) + 1)  # no symbol is shared by two texts
    shift = (bounds[chosen] - begins)[np.searchsorted(chosen, owner)]
    at, n = place - shift, len(symbols)
    forward = Suffixes(symbols).shared(at, at + period)
    backward = Suffixes(symbols[::-1]).shared(n - at, n - at - period)
    start, length = place - backward, period + backward + forward
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, the text of an id repeats itself; None for most ids, and for null."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _collapse(tail: Callable[[int | None, int], tuple[int, int] | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids, texts = batch.column("doc_id"), batch.column("text")
            words, bounds = hashed_rows(texts, lower=False)
            raw, offsets = string_buffers(texts)
            sources = {}
            for k, doc_id in enumerate(ids.to_pylist() if tail else ()):
                n = int(bounds[k + 1] - bounds[k])
                if planted := tail(doc_id, n):
                    a, p = planted
                    sources[k] = np.r_[np.arange(a), a + np.arange(n - a) % p]
                    words[bounds[k] : bounds[k + 1]] = words[bounds[k] : bounds[k + 1]][sources[k]]
            start, length, period = find_runs(words, bounds)
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, start + length, -1)
            kept = np.cumsum(depth[:-1]) == 0
            cuts = np.searchsorted(start, bounds)
            collapsed = []
            for k in range(batch.num_rows):
                own = raw[offsets[k] : offsets[k + 1]].tobytes().split()
                if k in sources or cuts[k + 1] > cuts[k]:
                    places = sources.get(k, np.arange(len(own)))[kept[bounds[k] : bounds[k + 1]]]
                    own = [own[i] for i in places]
                collapsed.append(b" ".join(own))
            start = start - np.repeat(bounds[:-1], np.diff(cuts))
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
            runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "text"])

    return run


def collapse_runs(df: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """``doc_id, n_words``, the ``runs`` (word numbers from 0), and the ``text`` with one period of each run, words joined by a space.

    ``tail`` may name a word and a period, by id and number of words, from which on a text is first made to repeat itself.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_collapse(tail), f"doc_id long, n_words long, runs {RUNS}, text string")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the run of greatest exponent and digests of runs and texts."""
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("l"))))
    rows = found.withColumn("best", best)
    shown = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.l) div (-best.p)").alias("exponent_milli"), F.sha2(shown, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
