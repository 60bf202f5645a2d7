"""Token ids of whole texts with a public tokenizer, by white-space chunk.

The tokenizer drops white space and never joins characters across it, so the
ids of a text are the ids of its chunks one after another.  A worker encodes a
chunk once and then looks it up; a word with punctuation behind it is looked up
as two, where the tokenizer parts them.  The table has a size limit; when it is
full it keeps what the current batch uses and forgets the rest.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

from loglattice.llm.textkit import small_batches, string_buffers  # noqa: E402

TOKENIZER = "word_bpe_49k.json"
_ENCODERS: dict[str, ChunkEncoder] = {}


#: The letters a-z and those of U+00C0 to U+00FF, of which no two compose.
_LETTERS = string.ascii_lowercase + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
#: A word of these letters, and ASCII punctuation behind it.
_PUNCTUATED = re.compile(rb"((?:[a-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)([!-/:-@[-`{-~]*+)").fullmatch


class _Table(dict):
    """Numbers chunks in the order in which they are first asked for.

    With ``parted``, a word with punctuation behind it has no number of its
    own: the word's is in its lower 32 bits, one more than the punctuation's in
    the upper ones.
    """

    def __init__(self, parted: bool, chunks: list[bytes]) -> None:
        super().__init__(zip(chunks, range(len(chunks)), strict=True))
        self.parted, self.entries, self.fresh = parted, len(chunks), []

    def __missing__(self, chunk: bytes) -> int:
        found = self.parted and _PUNCTUATED(chunk)
        if found and found[2]:
            at = self[found[1]] | (self[found[2]] + 1) << 32
        else:
            at, self.entries = self.entries, self.entries + 1
            self.fresh.append(chunk)
        self[chunk] = at
        return at


def _lowered_chunks(text: bytes) -> list[bytes]:
    """The text's chunks, ASCII letters in lower case where that can't change their ids.

    The tokenizer lower-cases all but its special tokens, but only after it has
    composed letters and marks; some letters compose with a mark in lower case
    only, so chunks beside combining marks (U+0300 to U+036F) stay as they are.
    """
    if b"<|" in text:
        return text.split()
    if b"\xcc" in text or b"\xcd" in text:
        return [chunk.lower() if chunk.isascii() else chunk for chunk in text.split()]
    return text.lower().split()


class ChunkEncoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, name: str = TOKENIZER, table_size: int = 1 << 19) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.table_size = table_size
        marks = ((mark, self._plain([mark])[0]) for mark in "\u2605\u2606\u25cf\u2022\u266a")
        self.images = self._letter_images()
        self.letters_whole = self.images is not None
        self.parted = self._parts_punctuation()
        self.clear()
        self.mark, self.mark_id = next((mark, int(ids[0])) for mark, ids in marks if len(ids) == 1)

    def clear(self) -> None:
        """Forgets all chunks."""
        self.table = _Table(self.parted, [])
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 12, dtype=np.int64)  # of entry k, at k + 1

    def _plain(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        """What of a text reaches the model."""
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def _letter_images(self) -> str | None:
        """The character by which each byte of a word of ``_LETTERS`` reaches the model; nothing where such a word doesn't reach it as one piece, byte by byte."""
        if not (self.tokenizer.normalizer and self.tokenizer.pre_tokenizer) or any(x.content.isalpha() for x in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        images = ["\ufffe"] * 256
        for letter in _LETTERS:
            for byte, image in zip(letter.encode(), "".join(self._pieces(letter)), strict=False):
                images[byte] = image
        table = "".join(images)
        words = [*_LETTERS, _LETTERS, _LETTERS[::-1]]
        return table if all(self._pieces(word) == [codecs.charmap_decode(word.encode(), "strict", table)[0]] for word in words) else None

    def _parts_punctuation(self) -> bool:
        """Whether words of ``_LETTERS`` and ASCII punctuation behind them are encoded apart."""
        if not self.letters_whole:
            return False
        tails = [string.punctuation, *map("".join, itertools.product(string.punctuation, repeat=2)), *string.punctuation]
        return all(self._pieces(letter + tail) == [*self._pieces(letter), *self._pieces(tail)] for letter, tail in [*itertools.product("a\u00e9", tails), *itertools.product(_LETTERS, string.punctuation)])

    def _marked(self, words: list[str]) -> list[list[int]]:
        """Ids of words that are encoded together, parted by a mark of one id; each alone if one holds the mark itself."""
        row = self._plain([f" {self.mark} ".join([*words, ""])])[0]
        if row.count(self.mark_id) != len(words):
            return self._plain(words)
        rows, at = [], 0
        for _ in words:
            end = row.index(self.mark_id, at)
            rows.append(row[at:end])
            at = end + 1
        return rows

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another and the number of each chunk's ids.

        Words of ``_LETTERS`` go to the tokenizer's model itself where
        normaliser and pre-tokenizer make nothing else of them; the others are
        encoded some at a time, as a long string costs more for each word.
        """
        tokenize, rows, rest = self.tokenizer.model.tokenize, [], []
        for k, chunk in enumerate(chunks):
            if self.letters_whole and (found := _PUNCTUATED(chunk)) and not found[2]:
                rows.append([x.id for x in tokenize(codecs.charmap_decode(chunk, "strict", self.images)[0])])
            else:
                rows.append([])
                rest.append(k)
        for k in range(0, len(rest), 100):
            some = rest[k : k + 100]
            for at, row in zip(some, self._marked([chunks[at].decode("utf-8", "replace") for at in some]), strict=True):
                rows[at] = row
        return np.fromiter(itertools.chain.from_iterable(rows), dtype=np.uint32), np.array([len(row) for row in rows], dtype=np.int64)

    def _forget(self, chunks: list[bytes]) -> None:
        used = np.zeros(self.table.entries, dtype=bool)
        used[self._entries(np.array([self.table[c] for c in set(chunks) if c in self.table], dtype=np.int64))[0]] = True
        keep = [c for c, at in self.table.items() if at < len(used) and used[at]]
        ids, ends = self._gather(np.flatnonzero(used))
        self.table = _Table(self.parted, keep)
        self.ids = np.r_[ids, np.zeros(1 << 16, dtype=np.uint32)]
        self.ends = np.r_[0, ends, np.zeros(1 << 12, dtype=np.int64)]

    def _add(self, chunks: list[bytes], have: int) -> None:
        ids, sizes = self._encode_chunks(chunks)
        fill = int(self.ends[have])
        if fill + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(len(ids), len(self.ids)), dtype=np.uint32)]
        if have + len(chunks) + 1 > len(self.ends):
            self.ends = np.r_[self.ends, np.zeros(max(len(chunks) + 1, len(self.ends)), dtype=np.int64)]
        self.ids[fill : fill + len(ids)] = ids
        self.ends[have + 1 : have + 1 + len(chunks)] = fill + np.cumsum(sizes)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of table entries one after another, and where each entry's end lies among them."""
        begin = self.ends[at]
        sizes = self.ends[at + 1] - begin
        stop = np.cumsum(sizes)
        return self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - sizes), sizes)], stop

    def _entries(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table entries of chunks one after another, and where each chunk's end lies among them."""
        tails = numbers >> 32
        ends = np.arange(1, len(numbers) + 1) + np.cumsum(tails > 0)
        entries = np.empty(ends[-1] if len(ends) else 0, dtype=np.int64)
        entries[ends - 1] = tails - 1
        entries[ends - 1 - (tails > 0)] = numbers & 0xFFFFFFFF
        return entries, ends

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text."""
        split = [_lowered_chunks(text) for text in texts]
        chunks = [c for row in split for c in row]
        if len(self.table) > self.table_size:
            self._forget(chunks)
        have = self.table.entries
        numbers = np.fromiter(map(self.table.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        fresh, self.table.fresh = self.table.fresh, []
        for k in range(0, len(fresh), 1000):
            self._add(fresh[k : k + 1000], have + k)
        entries, ends = self._entries(numbers)
        ids, stop = self._gather(entries)
        cuts = np.r_[0, stop][np.r_[0, ends][np.cumsum([0, *map(len, split)])]]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encoder(name: str = TOKENIZER) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = ChunkEncoder(name)
    return _ENCODERS[name]


def encoded(batches: Iterator[pa.RecordBatch], name: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids with the end id)`` of every row; a null text is empty.

    The table is given up at the end, as the worker may serve another stage next.
    """
    chunks = encoder(name)
    for batch in small_batches(batches, text_col, 4 << 20):
        raw, offsets = string_buffers(batch.column(text_col))
        data = raw.tobytes()
        rows = chunks.encode([data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        for key, ids in zip(batch.column(id_col).to_pylist(), rows, strict=True):
            yield key, np.append(ids, np.uint32(end_id))
    chunks.clear()


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
