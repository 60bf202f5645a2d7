import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import clashing, rows_of
from tokenizers import Tokenizer

from loglattice.llm import packing, tokens


def test_pieces_cover_every_document_once(awkward, awkward_rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    got = rows_of(packing.pack(clashing(awkward)))
    want = defaultdict(list)
    for r in awkward_rows:
        want[r[0]].append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    pieces = defaultdict(list)
    for doc_id, start, length, crc, total, *_ in got:
        pieces[doc_id].append((start, length, crc, total))
    assert set(pieces) == set(want)
    for doc_id, texts in want.items():
        if len(texts) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[doc_id]):
                assert start == at and total == len(texts[0]) and crc == zlib.crc32(texts[0][at : at + length].tobytes())
                at += length
            assert at == len(texts[0])
        else:
            assert sum(p[1] for p in pieces[doc_id]) == sum(map(len, texts))


def test_windows_are_gapless_and_full(awkward):
    windows = defaultdict(list)
    for row in rows_of(packing.pack(awkward, window=64)):
        windows[row[5]].append((row[6], row[2]))
    fills = defaultdict(list)
    for key, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 64
        fills[key >> 40].append(at)
    assert all(sum(n < 64 for n in own) <= 1 for own in fills.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_each_choice_has_the_least_sum_of_squares(seed):
    rng, window = np.random.default_rng(seed), 40
    packer = packing.LevelPacker(window)
    for k in range(300):
        size = int(rng.integers(1, window))
        before = packer.levels[1:window].copy()
        options = {}
        for level in [0, *(np.flatnonzero(before) + 1).tolist()]:
            if level + size <= window:
                after = np.zeros(window + 1, dtype=np.int64)
                after[1:window] = before
                after[level] -= level > 0
                after[level + size] += level + size < window
                options[level] = int((after[1:window] ** 2).sum())
        list(packer.put(k, np.zeros(size, dtype=np.uint32)))
        assert int((packer.levels[1:window] ** 2).sum()) == min(options.values())


def test_empty_table(nothing):
    assert packing.pack(nothing).count() == 0
