"""Token-id files: independent zstandard frames, a frame directory and a trailing seek table.

Layout of a file, front to back:

* zstandard frames.  Each decompresses on its own to a block: ``TIDB``, an
  unsigned 32-bit document count n, n validity bytes, n signed 64-bit ids, n
  unsigned 32-bit token counts, then all token ids as unsigned 32-bit integers.
* a skippable frame (magic ``0x184D2A50``): for every frame the first and last
  document id and the document count.  Ids ascend through the file, so a
  reader finds the frames of the documents it wants by bisection.
* a skippable frame (magic ``0x184D2A5E``) in the public seekable-zstandard
  form: compressed size, decompressed size and the low 32 bits of XXH64 of the
  decompressed bytes of every frame; then the frame count, a descriptor byte
  (checksums on) and the magic ``0x8F92EAB1``.

All integers are little-endian.  Writers stream: they hold one block at a time.

Defined results: null text is empty (the end id alone); null ids come first and
are marked by their validity byte; equal ids lie next to each other in the
order of their texts; an empty table gives no documents.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.llm import storage
from loglattice.llm.tokens import TOKENIZER, encoded, ids_crc32

END_ID = 1
FRAME_TOKENS = 1 << 18
_DIRECTORY, _SEEK, _SEEKABLE, _BLOCK = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, b"TIDB"

MANIFEST = "part long, path string, n_docs long, n_tokens long, n_bytes long"


class FrameWriter:
    """Writes one file to a binary stream."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS, level: int = 1) -> None:
        self.out, self.frame_tokens = out, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=level)
        self.entries: list[bytes] = []
        self.directory: list[bytes] = []
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.held = self.n_docs = self.n_tokens = self.n_bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.held += len(ids)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if self.held >= self.frame_tokens:
            self._frame()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _frame(self) -> None:
        if not self.docs:
            return
        keys = np.array([0 if k is None else k for k, _ in self.docs], dtype="<i8")
        valid = np.array([k is not None for k, _ in self.docs], dtype=np.uint8)
        sizes = np.array([len(ids) for _, ids in self.docs], dtype="<u4")
        block = b"".join([_BLOCK, struct.pack("<I", len(keys)), valid.tobytes(), keys.tobytes(), sizes.tobytes(), *(ids.astype("<u4").tobytes() for _, ids in self.docs)])
        packed = self.packer.compress(block)
        self._put(packed)
        self.entries.append(struct.pack("<III", len(packed), len(block), xxhash.xxh64_intdigest(block) & 0xFFFFFFFF))
        self.directory.append(struct.pack("<qqI", keys[0] if valid[0] else -(1 << 63), keys[-1] if valid[-1] else -(1 << 63), len(keys)))
        self.docs, self.held = [], 0

    def close(self) -> None:
        self._frame()
        body = b"".join(self.directory)
        self._put(struct.pack("<II", _DIRECTORY, len(body)) + body)
        body = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, _SEEKABLE)
        self._put(struct.pack("<II", _SEEK, len(body)) + body)


class FrameReader:
    """Reads one file from a seekable stream; frames are fetched one at a time."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, 2) or source.tell()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - 9 - 12 * count
        self.entries = np.frombuffer(self._at(table, 12 * count), dtype="<u4").reshape(count, 3)
        self.offsets = np.r_[0, np.cumsum(self.entries[:, 0].astype(np.int64))]
        kind = np.dtype([("first", "<i8"), ("last", "<i8"), ("n", "<u4")])
        self.directory = np.frombuffer(self._at(table - 8 - kind.itemsize * count, kind.itemsize * count), dtype=kind)

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents of frame ``k``, after its checksum is verified."""
        packed, size, check = (int(x) for x in self.entries[k])
        block = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), packed), max_output_size=size)
        if len(block) != size or xxhash.xxh64_intdigest(block) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        (n,) = struct.unpack_from("<I", block, 4)
        valid = np.frombuffer(block, np.uint8, n, 8)
        keys = np.frombuffer(block, "<i8", n, 8 + n)
        stops = np.cumsum(np.frombuffer(block, "<u4", n, 8 + 9 * n).astype(np.int64))
        ids = np.frombuffer(block, "<u4", offset=8 + 13 * n)
        for i in range(n):
            yield (int(keys[i]) if valid[i] else None), ids[stops[i - 1] if i else 0 : stops[i]]

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Only the wanted documents; other frames stay compressed."""
        wanted = np.unique(np.fromiter(wanted, dtype=np.int64))
        low = np.searchsorted(wanted, self.directory["first"])
        high = np.searchsorted(wanted, self.directory["last"], side="right")
        for k in np.flatnonzero(high > low):
            chosen = set(wanted[low[k] : high[k]].tolist())
            yield from ((key, ids) for key, ids in self.frame(int(k)) if key in chosen)


def write(df: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Encodes ``df(doc_id, text)`` into files of ``folder`` in ascending id order; returns the manifest.

    Rows are dealt by ranges of the id, with the text's hash as second key so
    that one very frequent id still spreads.  Each task writes under a name of
    its own; only the names of tasks that succeeded are in the manifest, which
    is itself written out, so retries and speculation leave no doubled rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        with system.open_output_stream(f"{root}/{name}") as out:
            writer = FrameWriter(out)
            for doc, ids in encoded(batches, tokenizer, end_id):
                writer.add(doc, ids)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_bytes": [writer.n_bytes]})

    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return storage.settle(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, from their frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = pyarrow.fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(path) as source:
                    reader, at = FrameReader(source), row["before"]
                    for k in range(len(reader.entries)):
                        keys, starts, sizes, sums = [], [], [], []
                        for key, ids in reader.frame(k):
                            keys.append(key)
                            starts.append(at)
                            sizes.append(len(ids))
                            sums.append(ids_crc32(ids))
                            at += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).select("part", "path", "before")
    spread = files.repartitionByRange(storage.workers(manifest.sparkSession), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes the documents below the shared folder and reads them back."""
    return read(write(df, storage.fresh(spark, "token-files")))
