"""Word-shingle sets and their parity sketches, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loglattice.llm.textkit import hashed_rows, mix64

WORDS = 5
#: Tokens that a part of the sketch holds in a set of its band's largest size.
LOAD = 4
#: Parts of a sketch that are joined on.
PARTS = 64
_TURN = np.uint64(0x632BE59BD9B4E019)


def band_edges(limit: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band; sizes grow by 16/9, two steps of the largest ratio of linked sizes."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(edges[-1] * 16 // 9 + 1)
    return np.array(edges, dtype=np.int64)


EDGES = band_edges()
_PLACES = [mix64(np.array([k + 1], dtype=np.uint64))[0] | np.uint64(1) for k in range(WORDS)]


def shingle_sets(words: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each row; a row with fewer words gives its whole sequence as one."""
    n = len(words)
    every = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        every += words[k : k + len(every)] * _PLACES[k]
    every = mix64(every)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(every[a : b - WORDS + 1])
        elif b > a:
            short = (words[a:b] * np.array(_PLACES[: b - a])).sum(keepdims=True)
            yield mix64(short + np.full(1, b - a, dtype=np.uint64) * _TURN)
        else:
            yield np.zeros(0, dtype=np.uint64)


def bands(size: int) -> list[int]:
    """The bands in which a set of this size is joined: its own, and the next if a linked set may lie there."""
    own = int(np.searchsorted(EDGES, size, side="right")) - 1
    return [own, own + 1] if 4 * size >= 3 * int(EDGES[own + 1]) else [own]


def part_keys(found: np.ndarray, band: int, parts: int | None = PARTS) -> np.ndarray:
    """Keys of the sketch parts of a set under a band.

    The tokens are dealt to P parts by hash and each part is the XOR of the
    64-bit hashes of its tokens, so two sets agree in a part exactly if they
    have the same tokens there (a part without tokens gives no key).  Small
    bands have fewer parts than wanted and repeat the deal with other seeds;
    large bands use the first ``parts`` parts.  ``None`` makes parts of one token:
    those that come first in the order of their hashes, one more than the set may
    have beside its link, so that a linked set has one of them for certain.
    """
    if parts is None:
        value = np.sort(mix64(found + np.uint64((band + 1) << 32)))
        return value[: len(found) - -(-3 * len(found) // 4) + 1].view(np.int64)
    top = int(EDGES[band + 1]) - 1
    total = max(2, -(-top // LOAD))
    deals = max(1, -(-parts // total))
    seeds = mix64(np.arange(band << 20, (band << 20) + deals, dtype=np.uint64) + _TURN)
    dealt = mix64(found[None, :] ^ seeds[:, None])
    part = (dealt % np.uint64(total)).astype(np.int64)
    value = mix64(dealt + _TURN)
    part += np.arange(deals, dtype=np.int64)[:, None] * total
    part, value = part.ravel(), value.ravel()
    if deals == 1 and total > parts:
        chosen = part < parts
        part, value = part[chosen], value[chosen]
    order = np.argsort(part, kind="stable")
    part, value = part[order], value[order]
    if not len(part):
        return np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    keys = np.bitwise_xor.reduceat(value, first)
    where = part[first].astype(np.uint64) + np.uint64((band + 1) << 32)
    return mix64(keys ^ mix64(where)).view(np.int64)


#: Length of a band's sample sketch in 64-bit words, and the tokens that it holds in a set of the band's largest size.
SAMPLE_WORDS, SAMPLE_LOAD = 16, 900


def sample_rate(band: int) -> float:
    """Share of the tokens that a band's sample sketch holds."""
    return min(1.0, SAMPLE_LOAD / (int(EDGES[band + 1]) - 1))


def sample_sketch(found: np.ndarray, band: int) -> np.ndarray:
    """Parity sketch of fixed length over the tokens that the band samples by hash."""
    mixed = mix64(found * _PLACES[0] + _TURN)
    held = mixed[(mixed >> np.uint64(32)).astype(np.float64) < sample_rate(band) * 2.0**32]
    counts = np.bincount((held & np.uint64(64 * SAMPLE_WORDS - 1)).astype(np.int64), minlength=64 * SAMPLE_WORDS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """One bit for each token's place modulo a power of two of at least four times the set's size, by XOR, in 64-bit words.

    Folding the upper half onto the lower gives the sketch of half the length,
    so sketches of different lengths can be compared.  The Hamming distance of
    two sketches is at most the size of the sets' symmetric difference.
    """
    bits = 64
    while bits < 4 * len(found):
        bits *= 2
    counts = np.bincount((mix64(found + _TURN) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def linked(a: int, b: int, difference: int) -> bool:
    """Similarity of at least 0.75 for set sizes and symmetric difference: 100 * both >= 75 * either."""
    return a > 0 and b > 0 and 7 * difference <= a + b


def sets_of(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Each batch with the shingle sets of its rows."""
    for batch in batches:
        words, bounds = hashed_rows(batch.column(batch.schema.get_field_index(text)), lower=True)
        yield batch, shingle_sets(words, bounds)
