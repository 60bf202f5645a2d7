"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Fit (on a bounded sample of distinct vectors): vectors are lifted so that the
largest inner product becomes the smallest angle; rotations are learned one after
the other by alternating sign codes and orthogonal fits, each from its own start,
and each adds a code of as many bits as the vectors have components.  The code is
cut into substrings of 16 bits, about log2 of a shard's rows.  The sample's own
nearest pairs (as many as correspond to ``k`` of all vectors) set the least number of bit flips, and then the least number of
substrings, at which ``WANTED`` of them agree within the flips in some substring,
and the radius within which nearly all of them lie.

Search: every shard indexes each substring of its codes.  A query probes, in each
substring's index, the buckets up to ``flips`` bits away.  By the pigeonhole
principle that retrieves every code within ``guaranteed`` bits, and most of those
beyond it up to the radius; codes further away are dropped, and the float vectors
of the others are ranked by inner product in double precision.  Queries that found
fewer than ``k`` although there are more candidates go through further rounds with
more flips and twice the radius, at last all bits, which is exact.

The stated query set meets all vectors in tiles of bounded size: index shards
against query blocks.  A vector is copied once for each query block and a query
once for each shard.  Equal vectors are one: for each distinct
vector only as many of its smallest ids as a result can hold are kept (exact,
and salted by id before), and it is searched once, so a vector that makes up a
third of the table costs no more than any other.

Vectors without any structure have neighbours almost at right angles, and then
probing cannot prune much: see the README for measured shares.

Defined results: vectors that are null, zero, hold null or non-finite
components, or differ in length from the longest, and null ids, take no part;
repeated rows count once; fewer candidates than ``k`` give fewer rows; ties go
to the smaller id; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm import storage

WIDTH = 16
#: Substrings and flips that a fit may use; four substrings are a word of 64 bits.
MOST_PIECES, FLIPS = 128, (1, 2, 3, 4)
WANTED = 0.94
SAMPLE = 8192
SHARD_ROWS, BLOCK_ROWS = 1 << 16, 1 << 16
SALTS = 64


def _masks(flips: int) -> np.ndarray:
    """All 16-bit numbers with at most so many bits."""
    out = [0]
    for n in range(1, min(flips, WIDTH) + 1):
        out += [sum(1 << b for b in chosen) for chosen in combinations(range(WIDTH), n)]
    return np.array(out, dtype=np.uint16)


@dataclass(frozen=True)
class Coder:
    """Rotations, the largest norm, the flips of a probe and the calibrated radius."""

    planes: np.ndarray
    top: float
    flips: int
    radius: int

    @property
    def bits(self) -> int:
        return self.planes.shape[1]

    @property
    def guaranteed(self) -> int:
        """The Hamming radius within which probing misses nothing."""
        return min(self.radius, self.bits // WIDTH * (self.flips + 1) - 1)

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Packed sign bits, one row of 16-bit substrings for each vector."""
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        lift = np.zeros_like(norms) if query else np.sqrt(np.maximum(self.top**2 - norms**2, 0))
        points = np.hstack([vectors, lift]) / (norms if query else self.top)
        return np.packbits(points @ self.planes > 0, axis=1, bitorder="little").view(np.uint16)

    def wider(self) -> Coder:
        """The next round's coder; the last one takes all codes."""
        flips = min(WIDTH, 2 * self.flips)
        return replace(self, flips=flips, radius=self.bits if flips == WIDTH else min(self.bits, 2 * self.radius))


def _rotation(points: np.ndarray, rng: np.random.Generator, rounds: int = 3) -> np.ndarray:
    turn = np.linalg.qr(rng.standard_normal((points.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(points.T @ np.where(points @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return turn


def _planes(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Some multiple of 64 planes from whole rotations."""
    held = _rotation(points, rng)
    while held.shape[1] < 64:
        held = np.hstack([held, _rotation(points, rng)])
    return held[:, : held.shape[1] // 64 * 64]


def fit(sample: np.ndarray, top: float, k: int, rows: int = 0, seed: int = 1, wanted: float = WANTED) -> Coder:
    """Learns a coder from a sample of ``rows`` distinct vectors; the nearest ``k`` of all are as near as the sample's nearest ``k`` times its share."""
    rng = np.random.default_rng(seed)
    norms = np.linalg.norm(sample, axis=1, keepdims=True)
    points = np.hstack([sample, np.sqrt(np.maximum(top**2 - norms**2, 0))]) / top
    planes = _planes(points, rng)
    if len(sample) < 2:
        return Coder(planes[:, :64].copy(), top, WIDTH, 64)
    asked = rng.permutation(len(sample))[:256]
    products = sample[asked] @ sample.T
    products[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-products, axis=1)[:, : min(-(-k * len(sample) // max(rows, len(sample))), len(sample) - 1)]

    def distances(planes: np.ndarray) -> np.ndarray:
        """Differing bits in each substring, one row for each near pair."""
        coder = Coder(planes, top, 0, 0)
        ours, theirs = coder.codes(sample[asked], True), coder.codes(sample, False)
        return np.bitwise_count(ours[:, None, :] ^ theirs[near]).reshape(near.size, -1)

    apart, flips, pieces = distances(planes), FLIPS[0], None
    while pieces is None:
        reached = np.maximum.accumulate(apart <= flips, axis=1).mean(axis=0)
        enough = np.flatnonzero(reached >= wanted)
        if len(enough):
            pieces = int(enough[0]) // 4 * 4 + 4
        elif apart.shape[1] < MOST_PIECES:
            more = _planes(points, rng)
            planes, apart = np.hstack([planes, more]), np.hstack([apart, distances(more)])
        elif flips < FLIPS[-1]:
            flips += 1
        else:
            pieces = apart.shape[1]
    whole = apart[:, :pieces].sum(axis=1, dtype=np.int64)
    return Coder(planes[:, : WIDTH * pieces].copy(), top, flips, int(np.quantile(whole, 0.995, method="higher")))


class ShardIndex:
    """Substring indexes of one shard's codes."""

    def __init__(self, coder: Coder, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.coder, self.ids, self.vectors = coder, ids, vectors
        self.codes = coder.codes(vectors, False)
        self.wide = self.codes.view(np.uint64)
        pieces = self.codes.shape[1]
        self.order = np.empty((pieces, len(ids)), dtype=np.int32)
        self.starts = np.zeros((pieces, (1 << WIDTH) + 1), dtype=np.int32)
        for j in range(pieces):
            self.order[j] = np.argsort(self.codes[:, j], kind="stable")
            np.cumsum(np.bincount(self.codes[:, j], minlength=1 << WIDTH), out=self.starts[j, 1:])
        self.masks = _masks(coder.flips)
        self.verified = self.ranked = 0

    def within(self, code: np.ndarray) -> np.ndarray:
        """Positions of the codes that probing retrieves within the radius."""
        if self.coder.flips == WIDTH:
            at = np.arange(len(self.ids))
        else:
            piece = np.repeat(np.arange(len(code)), len(self.masks))
            value = (code[:, None] ^ self.masks).ravel().astype(np.int64)
            begin, end = self.starts[piece, value], self.starts[piece, value + 1]
            full = np.flatnonzero(end > begin)
            piece, begin, size = piece[full], begin[full].astype(np.int64), (end - begin)[full].astype(np.int64)
            first = np.cumsum(size) - size
            place = np.arange(size.sum()) + np.repeat(begin + piece * len(self.ids) - first, size)
            seen = np.zeros(len(self.ids), dtype=bool)
            seen[self.order.ravel()[place]] = True
            at = np.flatnonzero(seen)
        apart = np.bitwise_count(self.wide[at] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)
        found = at[apart <= self.coder.radius]
        self.verified, self.ranked = self.verified + len(at), self.ranked + len(found)
        return found

    def search(self, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best that were retrieved, best first."""
        at = self.within(code)
        scores = self.vectors[at] @ query
        if len(at) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= least], scores[scores >= least]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[order]], scores[order]


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    return held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for every row that satisfies ``queries``."""
    rows = df.filter(queries.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), queries.alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, top, size = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == size).withColumn("same", F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b")))

    some = rows.select("vec_id", "v", "same").dropDuplicates(["vec_id", "same"])
    for keys in (["same", F.pmod("vec_id", F.lit(SALTS))], ["same"]):
        some = some.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    some = storage.settle(some.select("vec_id", "v", "same", "nth"), "ann-vectors")
    distinct = some.filter("nth = 1")
    drawn = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).toPandas()["v"]
    coder = fit(np.stack(drawn.to_numpy()).astype(np.float64), float(top) * (1 + 1e-9), k, distinct.count())
    asked = storage.settle(rows.filter("asked").select("vec_id", "same").distinct(), "ann-queries")
    shards = -(-total // SHARD_ROWS)
    order = [F.desc("score"), "vec_id"]

    def meet(needles: DataFrame, wider: Coder) -> DataFrame:
        """The best ``k + 1`` within the radius for every needle, met with every shard."""
        blocks = -(-needles.count() // BLOCK_ROWS) or 1
        mixed = F.xxhash64("vec_id")
        index = some.select("vec_id", "v", F.pmod(mixed, F.lit(shards).cast("long")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        needles = needles.select("same", "v", F.pmod(mixed, F.lit(blocks).cast("long")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            out_a, out_b, out_ids, out_scores = [], [], [], []
            if left.num_rows and right.num_rows:
                shard = ShardIndex(wider, left.column("vec_id").to_numpy(), _rows(left.column("v")))
                wanted = _rows(right.column("wanted"))
                for key, query, code in zip(right.column("same").to_pylist(), wanted, wider.codes(wanted, True), strict=True):
                    ids, scores = shard.search(query, code, k + 1)
                    out_a += [key["a"]] * len(ids)
                    out_b += [key["b"]] * len(ids)
                    out_ids.append(ids)
                    out_scores.append(scores)
            ids = np.concatenate(out_ids) if out_ids else np.zeros(0, dtype=np.int64)
            scores = np.concatenate(out_scores) if out_scores else np.zeros(0)
            return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int32()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

        index, needles = index.toDF("vec_id", "v", "shard", "block"), needles.toDF("same", "wanted", "at_block", "at_shard")
        found = index.groupBy("shard", "block").cogroup(needles.groupBy("at_shard", "at_block")).applyInArrow(scan, "a long, b int, vec_id long, score double")
        best = found.withColumn("nth", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))).filter(F.col("nth") <= k + 1)
        return storage.settle(best, "ann-found")

    needles = some.filter("nth = 1").join(asked.select("same").distinct(), "same", "left_semi")
    full = min(k + 1, some.count())
    best = meet(needles, coder)
    while coder.flips < WIDTH:
        done = best.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= full).select(F.struct("a", "b").alias("same"))
        needles = storage.settle(needles.join(done, "same", "left_anti"), "ann-unfilled")
        if needles.isEmpty():
            break
        coder = coder.wider()
        again = needles.select("same.a", "same.b")
        best = best.join(again, ["a", "b"], "left_anti").unionByName(meet(needles, coder))
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("same.a").alias("a"), F.col("same.b").alias("b")).join(best, ["a", "b"]).filter("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
