"""Toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney models, one of toxic and one of ordinary training documents, of
words and of bigrams.  Every level takes a discount off each count and gives what
it took to the level below: bigrams to the class's continuation counts (before
how many different words a word stands), those, and the plain word counts of the
one-word model, to a level that the classes share, uniform over the words of
both and one unknown word.  So an expression that is rare in both classes gets
about the same probability from both, and one that is frequent in one class only
doesn't.  A word is a history of the bigram model if both classes have seen it
``HISTORY`` times; after other words, and at the head of a text, both classes take the level below, since a
likelihood is only comparable where both models know the history.

A document's evidence is the difference of its log-likelihoods under the two
models, normalised by length, over its best stretch: a stretch has at most 1, 2,
4 or 12 words, or is the whole text.  A fold of training documents that the
models haven't seen chooses the model's order and the length of the stretch, by
the log loss of a logistic calibration; the score is that one normalised
difference, calibrated, so it grows with it.

Documented bound of the fit: at most ``class_docs`` labelled documents of each
class, drawn by the hash of their id, whole texts.  All their words are kept,
and all bigrams after a history, however rare.  Scoring covers every whole text.
The model is broadcast; its size is bounded by the texts of the sample.

Defined results: null or empty text has a difference of 0; labels that are null don't count; an id with several
labels counts as toxic if any is; repeated rows are scored each; if training
lacks a class, every score is the training rows' toxic share (0 without rows);
columns other than doc_id, text and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm import storage
from loglattice.llm.textkit import hashed_rows, mix64, small_batches

CLASS_DOCS = 8000
DISCOUNT = 0.75
HISTORY = 100
ORDERS, STRETCHES = (1, 2), (1, 2, 4, 12, None)
_START = np.uint64(0x6A09E667F3BCC908)
_PAIR = np.uint64(0xBB67AE8584CAA73B)


def remainder(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word before each (a start mark at the head of a document) and the row bounds."""
    words, bounds = hashed_rows(text, lower=True, bare=True)
    before = np.empty_like(words)
    if len(words):
        before[1:] = words[:-1]
        before[bounds[:-1][bounds[:-1] < bounds[1:]]] = _START
    return words, before, bounds


def _counts(sample: DataFrame) -> DataFrame:
    """``h, w, t, o``: how often word w follows word h in toxic and in ordinary documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words, before, bounds = _tokens(batch.column("text"))
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64), np.diff(bounds))
            _, first, index = np.unique(mix64(before * _PAIR) + words, return_index=True, return_inverse=True)
            t = np.bincount(index, weights=toxic, minlength=len(first)).astype(np.int64)
            n = np.bincount(index, minlength=len(first))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (before[first].view(np.int64), words[first].view(np.int64), t, n - t)], names=["h", "w", "t", "o"])

    return sample.mapInArrow(run, "h long, w long, t long, o long").groupBy("h", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


@dataclass
class Model:
    """Sorted word and bigram hashes with what the two classes (toxic, ordinary: rows 0 and 1) make of them."""

    words: np.ndarray
    plain: np.ndarray  # p(w) of the one-word model, by class and word; last the unknown word's
    lower: np.ndarray  # the same from continuation counts, below the bigrams
    back: np.ndarray  # weight of the lower level after this word
    pairs: np.ndarray
    arcs: np.ndarray  # discounted p(w | h), by class and bigram

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def probabilities(self, words: np.ndarray, before: np.ndarray, order: int) -> np.ndarray:
        """p(word | words before) of both classes for every token."""
        at, known = self._find(self.words, words)
        at = np.where(known, at, len(self.words))
        if order == 1:
            return self.plain[:, at]
        back, old = self._find(self.words, before)
        arc, seen = self._find(self.pairs, mix64(before * _PAIR) + words)
        out = self.lower[:, at] * np.where(old, self.back[:, back] if len(self.words) else 1.0, 1.0)
        return out + np.where(seen, self.arcs[:, arc], 0.0) if len(self.pairs) else out

    def evidence(self, text: pa.Array, orders: tuple[int, ...] = ORDERS, stretches: tuple[int | None, ...] = STRETCHES) -> np.ndarray:
        """For each document the normalised difference over its best stretch, a column for each order and length."""
        words, before, bounds = _tokens(text)
        out = np.zeros((len(bounds) - 1, len(orders), len(stretches)))
        for i, order in enumerate(orders):
            toxic, ordinary = self.probabilities(words, before, order)
            sums = np.r_[0.0, np.cumsum(np.log(toxic) - np.log(ordinary))]
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if b > a:
                    own = sums[a : b + 1]
                    for j, width in enumerate(stretches):
                        n = min(width or b - a, b - a)
                        out[k, i, j] = (own[n:] - own[:-n]).max() / n
        return out.reshape(len(out), -1)


def _level(counts: np.ndarray, discount: float) -> np.ndarray:
    """Discounted shares of counts, and of an unknown word, over the shared uniform level; counts that are all 0 leave that level alone."""
    total, rest = counts.sum(), np.minimum(counts, discount).sum()
    share = np.r_[counts - np.minimum(counts, discount), 0.0] / max(total, 1)
    return share + (rest / total if total else 1.0) / (len(counts) + 1)


def _model(counts: DataFrame, discount: float = DISCOUNT, history: int = HISTORY) -> Model:
    sums = [F.sum("t").alias("t"), F.sum("o").alias("o")]
    kinds = [F.count_if(F.col("t") > 0).alias("kt"), F.count_if(F.col("o") > 0).alias("ko")]
    w = counts.groupBy("w").agg(*sums, *kinds).toPandas()
    held = counts.groupBy("h").agg(*sums, *[F.sum(F.least(F.col(c), F.lit(discount))).alias(f"d{c}") for c in ("t", "o")])
    held = held.filter((F.col("t") >= history) & (F.col("o") >= history) & (F.col("h") != int(_START.astype(np.int64))))
    held = storage.settle(held, "toxic-histories")
    h = held.toPandas()

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name).to_numpy() for name in batch.schema.names}
            pair = mix64(c["h"].view(np.uint64) * _PAIR) + c["w"].view(np.uint64)
            shares = [np.maximum(c[k] - discount, 0) / c[n] for k, n in (("t", "ht"), ("o", "ho"))]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (pair, *shares)], names=["pair", "t", "o"])

    joined = counts.join(held.select("h", F.col("t").alias("ht"), F.col("o").alias("ho")), "h").select("h", "w", "t", "o", "ht", "ho")
    packed = [[np.frombuffer(x) for x in row] for row in joined.mapInArrow(arcs, "pair binary, t binary, o binary").toLocalIterator()]  # a partition at a time
    pair, *shares = (np.concatenate([row[k] for row in packed] or [np.zeros(0)]) for k in range(3))
    pair = pair.view(np.uint64)
    turn = np.argsort(pair)

    key = w["w"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    level = lambda *columns: np.stack([_level(w[c].to_numpy().astype(float)[order], discount) for c in columns])
    key = key[order]
    back = np.ones((2, len(key)))
    at, _ = Model._find(key, h["h"].to_numpy().view(np.uint64))
    for row, (n, d) in enumerate((("t", "dt"), ("o", "do"))):
        back[row, at] = h[d] / h[n]
    return Model(key, level("t", "o"), level("kt", "ko"), back, pair[turn], np.stack(shares)[:, turn])


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Intercept and slope (at least 0) of a ridge logistic regression on one statistic, and its log loss."""
    mean, scale = x.mean(), x.std() + 1e-9
    z = np.stack([np.ones(len(x)), (x - mean) / scale], axis=1)
    beta, penalty = np.zeros(2), np.diag([1e-6, ridge])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        beta += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ beta)
    slope = max(0.0, beta[1])
    p = 1 / (1 + np.exp(-np.clip(beta[0] + slope * z[:, 1], -30, 30)))
    loss = -(weight * np.log(np.where(y == 1, p, 1 - p))).mean()
    return beta[0] - slope * mean / scale, slope / scale, float(loss)


def score(df: DataFrame, labels: DataFrame, class_docs: int = CLASS_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; only labels of rows outside fold 0 are learned from."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = remainder(F.col("doc_id"))
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    shares = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if row["toxic"] in (0, 1)}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    schema = "doc_id long, held_out boolean, score double, predicted int"

    judge = None
    if shares.get(0) and shares.get(1):
        drawn = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_docs) for c in (0, 1)]
        ids = storage.settle(drawn[0].union(drawn[1]), "toxic-sample")
        sample = storage.settle(docs.join(F.broadcast(ids), "doc_id").withColumn("fold", fold), "toxic-texts")  # at most 2 * class_docs ids
        counts = storage.settle(_counts(sample.filter("fold <> 4")), "toxic-counts")
        if not counts.isEmpty():
            held = spark.sparkContext.broadcast(_model(counts))
            names = [f"e{k}" for k in range(len(ORDERS) * len(STRETCHES))]

            def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in small_batches(batches, "text"):
                    x = held.value.evidence(batch.column("text"))
                    yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), *(pa.array(np.ascontiguousarray(column)) for column in x.T)], names=["toxic", *names])

            seen = sample.filter("fold = 4").select("toxic", "text").mapInArrow(weigh, "toxic int, " + ", ".join(f"{f} double" for f in names)).toPandas()
            y = seen["toxic"].to_numpy().astype(float)
            if 0 < y.sum() < len(y):
                weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
                fits = [_calibrate(seen[name].to_numpy(), y, weight) for name in names]
                best = int(np.argmin([loss for _, _, loss in fits]))
                chosen = ((ORDERS[best // len(STRETCHES)],), (STRETCHES[best % len(STRETCHES)],))
                judge = (held, chosen, *fits[best][:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            if judge is None:
                p = np.full(batch.num_rows, prior)
            else:
                held, chosen, base, slope = judge
                p = 1 / (1 + np.exp(-np.clip(base + slope * held.value.evidence(batch.column("text"), *chosen)[:, 0], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (fold == 0).alias("held_out")).mapInArrow(run, schema)
