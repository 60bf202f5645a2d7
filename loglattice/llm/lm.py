"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model (``order`` 3), each order smoothed towards the one
below it:

    p1(w)     = (c(w) + 1) / (N + V + 1)
    pk(w | h) = (c(h w) + mu_k p(k-1)(w | h')) / (c(h) + mu_k)

Its states are the contexts seen in training, up to ``order - 1`` words long, and
the root.  A state has an arc for every word seen after it; its failure arc, of
weight ``mu_k / (c(h) + mu_k)``, leads to the context without its first word.
Where no arc carries the word, that weight is exactly what the formula leaves, so
arcs and failures together are the smoothed model.  Every document is read once
from left to right: the automaton tries the current state's arc, follows failure
arcs down to one that carries the word, and goes on in the longest context that
is a state.  A word outside the vocabulary is taken at the root.

No task holds the whole model.  A task cuts its documents into blocks of bounded
size; a block asks for the distinct n-grams it holds and brings its own training
counts of them.  Both go, packed as arrays, to the n-gram's shard, which adds up
the counts of all blocks and answers each block in the order of its question.
Then the block's documents, packed in one row, meet its answers, and the block
builds the part of the automaton that they can visit.  N-grams are combined
within a block before the shuffle, and shards are ranges of the hash of the whole
n-gram, so a very frequent word or phrase is one entry for each block, and what is
sent is at most one entry for each token and order.  Blocks follow the input's
partitions, however many equal rows they hold.  N-grams are told apart by 64-bit
hashes.

Defined results: null text is empty and scores its end token alone; a null id
is hashed as the empty string when folds are dealt; repeated rows count as
often as they occur; with no training rows N and V are zero; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm import storage
from loglattice.llm.textkit import hashed_rows, mix64, string_buffers

#: Smoothing of the orders above one; a model of order n takes the first n - 1.
MU = (20.0, 4.0, 2.0, 1.0)
ORDER = 3
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
_END = np.uint64(0x1F83D9ABFB41BD6B)
_START = np.uint64(0x5BE0CD19137E2179)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


class Block:
    """Tokens of a block of documents: word hashes with an end token each, and the n-grams that end at every token."""

    def __init__(self, text: pa.Array, order: int = ORDER) -> None:
        words, bounds = hashed_rows(text, lower=True)
        rows = len(bounds) - 1
        self.order = order
        self.ends = bounds[1:] + np.arange(1, rows + 1)
        self.begins = np.r_[0, self.ends[:-1]].astype(np.int64)
        self.words = np.insert(words, bounds[1:], _END) if rows else words
        self.sizes = self.ends - self.begins

    def keys(self) -> Iterator[np.ndarray]:
        """For each order, the key of the n-gram ending at every token; start marks stand before a document."""
        own, start = self.words, _START
        yield own
        for _ in range(1, self.order):
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[self.begins] = start
            own = mix64(before * _PAIR) + self.words
            start = (mix64(np.array([start * _PAIR], dtype=np.uint64)) + _START)[0]
            yield own

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each order: distinct keys and the place of every token's key among them."""
        for order, keys in enumerate(self.keys(), 1):
            yield order, *np.unique(keys, return_inverse=True)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    width = max(1, -(-int(numbers.max()).bit_length() // 8)) if len(numbers) else 1
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, dtype=np.uint8).reshape(n, -1)
    return out.view("<u8").ravel()


def _bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted keys; shards are ranges of the hash."""
    edges = np.array([(s << 64) // shards for s in range(shards)], dtype=np.uint64)
    return np.r_[np.searchsorted(keys, edges), len(keys)]


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a partition in blocks, each with a number of its own; a block ends with the row that fills ``limit`` bytes of text.

    Where the batches are cut doesn't matter.  The number also holds the block's
    content, so that blocks of two readings are only taken as the same if they are.
    """
    held, size, place = [], 0, 0

    def close() -> tuple[int, pa.Table]:
        text, lengths = xxhash.xxh64(seed=place), xxhash.xxh64(str(TaskContext.get().partitionId()).encode())
        for batch in held:
            raw, offsets = string_buffers(batch.column(1))
            text.update(raw.tobytes())
            lengths.update(np.diff(offsets).tobytes())
        return (text.intdigest() ^ lengths.intdigest()) - (1 << 63), pa.Table.from_batches(held)

    for batch in batches:
        _, offsets = string_buffers(batch.column(1))
        at = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - size))))
            held.append(batch.slice(at, to - at))
            size, at = size + int(offsets[to] - offsets[at]), to
            if size >= limit:
                yield close()
                held, size, place = [], 0, place + 1
    if held:
        yield close()


def _ask(shards: int, order: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, docs in blocks(batches, limit):
            block, out = Block(docs.column("text").combine_chunks(), order), []
            weight = np.repeat(docs.column("train").to_numpy().astype(np.float64), block.sizes)
            for gram, keys, index in block.grams():
                counts = np.bincount(index, weights=weight, minlength=len(keys)).astype(np.uint64)
                cuts = _bounds(keys, shards)
                steps = np.diff(keys, prepend=np.uint64(0))
                for s in np.flatnonzero(np.diff(cuts)):
                    a, b = cuts[s], cuts[s + 1]
                    out.append((number, gram, gram * shards + int(s), b - a, int(keys[a]) - (1 << 63), packed(steps[a + 1 : b]), packed(counts[a:b])))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "gram", "shard", "size", "first", "steps", "counts"])

    return run


def packed_documents(docs: pa.Table) -> bytes:
    """A table as one compressed stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(docs.combine_chunks())
    return sink.getvalue().to_pybytes()


def kept_blocks(limit: int):
    """Each block with its documents in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, docs in blocks(batches, limit):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed_documents(docs)], pa.binary())], names=["block", "docs"])

    return run


def _answer(asked: pa.Table) -> pa.Table:
    sizes = asked.column("size").to_pylist()
    keys = []
    for first, steps, n in zip(asked.column("first").to_pylist(), asked.column("steps"), sizes, strict=True):
        steps = unpacked(steps.as_buffer(), n - 1)
        keys.append(np.cumsum(np.r_[np.uint64(first + (1 << 63)), steps], dtype=np.uint64))
    counts = [unpacked(x.as_buffer(), n).astype(np.int64) for x, n in zip(asked.column("counts"), sizes, strict=True)]
    every = np.unique(np.concatenate(keys))
    total = np.zeros(len(every), dtype=np.int64)
    places = [np.searchsorted(every, k) for k in keys]
    for at, n in zip(places, counts, strict=True):
        total[at] += n
    types, tokens = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    types[0], tokens[0] = np.count_nonzero(total), total.sum()
    out = {c: asked.column(c) for c in ("block", "gram", "shard", "size")}
    return pa.table(out | {"counts": pa.array([packed(total[at]) for at in places], pa.binary()), "types": pa.array(types), "tokens": pa.array(tokens)})


class Automaton:
    """The states and arcs that one block's documents can visit.

    ``arcs[k]`` has the weight of the order k + 1 arc over every token, 0 where
    training has no such n-gram; ``fails[k]`` the failure weight of the state
    that is the k words before the token, 1 where that is no state.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], starts: int, tokens: int, types: int, mu: tuple[float, ...] = MU) -> None:
        self.block, self.counts = block, counts
        smooth = (counts[0] + 1) / (tokens + types + 1)
        self.root = smooth
        self.arcs, self.fails = [smooth], [np.ones(len(smooth))]
        for k in range(1, block.order):
            history = np.empty_like(counts[k - 1])
            history[1:] = counts[k - 1][:-1]
            history[block.begins] = starts
            fail = np.where(history > 0, mu[k - 1] / (history + mu[k - 1]), 1.0)
            smooth = counts[k] / (history + mu[k - 1]) + fail * smooth
            self.arcs.append(np.where(counts[k] > 0, smooth, 0.0))
            self.fails.append(fail)

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """Base score and model score of every document.

        The longest context that is a state doesn't depend on the way to it, so
        all tokens take their step at once: from the longest context down, those
        without an arc take the failure arc, the others stop.
        """
        weight, walking = np.zeros(len(self.root)), np.ones(len(self.root), dtype=bool)
        for arc, fail in zip(self.arcs[::-1], self.fails[::-1], strict=True):
            taken = walking & (arc > 0)
            weight[taken] += np.log10(arc[taken])
            walking &= ~taken
            weight[walking] += np.log10(fail[walking])
        return np.add.reduceat(np.log10(self.root), self.block.begins), np.add.reduceat(weight, self.block.begins)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ASKED = "block long, gram int, shard long, size long, first long, steps binary, counts binary"
_ANSWERED = "block long, gram int, shard long, size long, counts binary, types long, tokens long"


def score(df: DataFrame, train: Column, order: int = ORDER, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores every whole text; ``train`` marks the rows to learn from.

    ``df`` is read twice; if the readings differ (as with random columns), the job fails.
    """
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    total, starts = rows.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    least = storage.workers(spark)
    shards = max(least, -(-(total or 0) // SHARD_BYTES))
    tasks = max(least, -(-(total or 0) // (2 * block_bytes)))
    with storage.small_arrow_batches(spark):
        asked = rows.mapInArrow(_ask(shards, order, block_bytes), _ASKED).repartition(max(least, shards), "shard")
        answers = storage.settle(asked.groupBy("shard").applyInArrow(_answer, _ANSWERED), "lm-answers")
    types, tokens = answers.filter("gram = 1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()

    def finish(kept: pa.Table, got: pa.Table) -> pa.Table:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if kept.num_rows != 1 or not got.num_rows:
            raise RuntimeError("two readings of the documents differ")
        docs = pa.ipc.open_stream(kept.column("docs")[0].as_buffer()).read_all()
        block = Block(docs.column("text").combine_chunks(), order)
        taught = docs.column("train").to_numpy().astype(bool)
        found: list[list] = [[] for _ in range(order)]
        for gram, _, data, size in sorted(zip(*(got.column(c).to_pylist() for c in ("gram", "shard", "counts", "size")), strict=True)):
            found[gram - 1].append(unpacked(data, size).astype(np.int64))
        counts = [np.concatenate(found[gram - 1])[index] for gram, _, index in block.grams()]
        machine = Automaton(block, counts, starts, tokens, types, mu)
        base, full = machine.traverse()
        known = np.add.reduceat((counts[0] > 0).astype(np.int64), block.begins)
        values = [docs.column("doc_id").combine_chunks(), pa.array(~taught), block.sizes, known, np.full(len(base), tokens), base, full]
        return pa.table([pa.array(v, t) if isinstance(v, np.ndarray) else v for v, t in zip(values, kinds, strict=True)], names=columns)

    with storage.small_arrow_batches(spark):
        kept = rows.mapInArrow(kept_blocks(block_bytes), "block long, docs binary").repartition(tasks, "block")
        given = answers.select("block", "gram", "shard", "counts", "size").repartition(tasks, "block")
        return kept.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(finish, SCHEMA)
