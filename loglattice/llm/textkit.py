"""Vectorised word hashing over Arrow string columns.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All functions work on
the raw UTF-8 buffer, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut at white space.
PIECE = 1 << 18
_RADIX = np.uint64(0x9E3779B97F4A7C55)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
_OUTSIDE = np.zeros(256, dtype=bool)
_OUTSIDE[:128] = [not chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the radix and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(_RADIX), -1, 1 << 64))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _RADIX)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse)], dtype=np.uint64)
        return self.up, self.down


POWERS = _Powers()


def _hash_piece(raw: np.ndarray, lower: bool, cuts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of ``raw``; no word crosses an offset in ``cuts``."""
    word = ~space[raw]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = POWERS.upto(len(raw) + 1)
    values = (_LOWER[raw] if lower else raw).astype(np.uint64)
    values += np.uint64(1)
    values *= up[: len(raw)]
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def hash_words(raw: np.ndarray, lower: bool, cuts: np.ndarray = np.zeros(0, dtype=np.int64), space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in a byte buffer, and where each starts."""
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            gaps = np.flatnonzero(space[raw[at:end]])
            while not len(gaps) and end < len(raw):
                at_end, end = end, min(len(raw), end + PIECE)
                gaps = np.flatnonzero(space[raw[at_end:end]]) + (at_end - at)
            if end < len(raw):
                end = at + int(gaps[-1]) + 1
        got, starts, _ = _hash_piece(raw[at:end], lower, cuts - at, space)
        hashes.append(got)
        places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashed_rows(column: pa.Array, lower: bool, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, joined together, and the row bounds within them; ``bare`` words have no ASCII punctuation."""
    raw, offsets = string_buffers(column)
    hashes, starts = hash_words(raw, lower, offsets, _OUTSIDE if bare else _SPACE)
    return hashes, np.searchsorted(starts, offsets)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text column of each has about ``limit`` bytes; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
