from dataclasses import replace

import numpy as np
import pytest
from cases import rows_of
from pyspark.sql import functions as F

from loglattice.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, k):
    out = {}
    for i, a in enumerate(ids):
        if a % 20 == 0:
            scores = vectors @ vectors[i]
            order = sorted((-s, b) for j, (s, b) in enumerate(zip(scores, ids, strict=True)) if b != a)
            out[a] = order[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 32))
    out = (centres[rng.integers(0, 12, 900)] + 0.5 * rng.standard_normal((900, 32))).astype(np.float32)
    out[400:460] = out[400]  # a group of copies
    return out


def test_recall_and_scores(spark, vectors):
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)]
    bad = [(2000, None, 0), (2001, [], 0), (2020, [0.0] * 32, 0), (2040, [float("nan")] * 32, 0), (2060, [None] * 32, 0), (2080, [1.0] * 31, 0), (None, [1.0] * 32, 0), (0, vectors[0].tolist(), 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumn("same", F.lit(3)).repartition(5)
    got = rows_of(ann.search(df, F.col("vec_id") % 20 == 0))
    want = brute(list(range(900)), vectors.astype(np.float64), 20)
    found = {}
    for query, rank, vec, score in got:
        found.setdefault(query, []).append((rank, vec, score))
    assert set(found) <= set(want)
    hits = 0
    for query, order in want.items():
        mine = sorted(found.get(query, []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        for _, vec, score in mine:
            assert score == pytest.approx(float(vectors[vec].astype(np.float64) @ vectors[query].astype(np.float64)), rel=1e-9)
        hits += len({v for _, v, _ in mine} & {v for _, v in order})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], SCHEMA)
    got = sorted(rows_of(ann.search(df, F.col("vec_id") % 20 == 0)))
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(20, [1.0], 0)], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_probing_finds_every_code_within_the_guaranteed_radius(vectors):
    """Pigeonhole: no code within the guaranteed radius is missed, and nothing beyond the radius is ranked."""
    for coder in (ann.fit(vectors.astype(np.float64), 40.0, 20), replace(ann.fit(vectors.astype(np.float64), 40.0, 20), flips=2)):
        index = ann.ShardIndex(coder, np.arange(len(vectors)), vectors.astype(np.float64))
        for code in index.codes[:40]:
            apart = np.bitwise_count(index.wide ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)
            found = set(index.within(code))
            assert set(np.flatnonzero(apart <= coder.guaranteed)) <= found <= set(np.flatnonzero(apart <= coder.radius))


@pytest.mark.parametrize(("spread", "most_verified", "most_ranked"), [(0.35, 0.05, 0.05), (None, 0.25, 0.05)])
def test_probing_prunes(spread, most_verified, most_ranked):
    """Shares of the vectors that are verified and ranked, with and without clusters, at a recall of 0.9."""
    rng = np.random.default_rng(11)
    if spread is None:
        some = rng.standard_normal((20000, 64))
    else:
        some = rng.standard_normal((400, 64))[rng.integers(0, 400, 20000)] + spread * rng.standard_normal((20000, 64))
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    coder = ann.fit(some[:4096], 1.0 + 1e-9, 20, len(some))
    index = ann.ShardIndex(coder, np.arange(len(some)), some)
    hits = 0
    for query, code in zip(some[-50:], coder.codes(some[-50:], True), strict=True):
        found, _ = index.search(query, code, 20)
        hits += len(set(found) & set(np.argsort(-(some @ query))[:20]))
    assert hits >= 0.9 * 50 * 20
    assert index.verified <= most_verified * 50 * len(some)
    assert index.ranked <= most_ranked * 50 * len(some)


def test_ties_at_the_last_rank(spark):
    """Different vectors with equal scores: the smaller ids win the last places."""
    rows = [(0, [1.0, 0.0, 0.0], 0), *((k, [0.5, 0.1 * k, 1.0], 0) for k in range(1, 40))]
    got = sorted(rows_of(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0)), key=lambda r: r[1])
    assert [(r[1], r[2], r[3]) for r in got] == [(k, k, 0.5) for k in range(1, 21)]


def test_every_query_gets_its_full_number(spark):
    """Outliers beside a hot cluster with copies, and few vectors, get as many rows as there are candidates."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    some = centre + 0.05 * rng.standard_normal((700, 32))
    some[100:400] = some[100]
    some[::20][:10] = -3 * centre + 2 * rng.standard_normal((10, 32))
    for vectors in (some, rng.standard_normal((15, 32))):
        df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], SCHEMA).repartition(3)
        got = rows_of(ann.search(df, F.col("vec_id") % 20 == 0))
        asked, most = range(0, len(vectors), 20), min(20, len(vectors) - 1)
        assert sorted((q, r) for q, r, _, _ in got) == [(q, r) for q in asked for r in range(1, most + 1)]
