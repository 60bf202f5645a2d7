import random

import pytest
from cases import SCHEMA, clashing, prose, rows_of
from plain import components as brute
from plain import shingles

from loglattice.llm import ngram_join


def graded(rng, copies):
    """Groups of texts that lie on both sides of the threshold."""
    rows, at = [], 1000
    for size in (6, 12, 40, 150, 700):
        for _ in range(4):
            base = prose(rng, size, 5000).split()
            for share in range(copies):
                text = base.copy()
                for _ in range(share * size // 60 + (share > 0)):
                    text[rng.randrange(len(text))] = f"new{rng.randrange(9999)}"
                rows.append((at, " ".join(text), "en", "a", 1))
                at += 1
    return rows


@pytest.mark.parametrize("parts", [64, None])
def test_components_match_all_pairs(spark, awkward_rows, parts):
    rows = awkward_rows + graded(random.Random(3), 6)
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), parts))
    want = brute(rows)
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got) == sorted((r[0] is None, r[0] or 0, len(shingles(r[1]))) for r in rows)
    assert {r[0]: r[2] for r in got if r[0] is not None} == want


def test_exact_threshold(spark):
    """Seven of nine shingles shared is over the threshold, exactly 0.75 counts, a little less doesn't."""
    base = [f"t{k}" for k in range(34)]  # 30 shingles
    rows = [(1, " ".join(base), "en", "a", 1)]
    rows.append((2, " ".join(base[:-5] + ["x"]), "en", "a", 1))  # 25 shared of 31
    rows.append((3, " ".join(base + [f"y{k}" for k in range(10)]), "en", "a", 1))  # 30 of 40: exactly 0.75
    rows.append((4, " ".join(["z" + b for b in base]), "en", "a", 1))
    rows.append((5, " ".join(["z" + b for b in base] + [f"y{k}" for k in range(11)]), "en", "a", 1))  # 30 of 41
    got = {r[0]: r[2] for r in rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)))}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_chains_and_hot_groups(spark):
    """A chain of near copies is one component though its ends differ; a large group of copies stays linear."""
    rng = random.Random(9)
    text, rows = prose(rng, 200, 3000).split(), []
    for k in range(25):
        text = text.copy()
        text[(k * 7) % 200] = f"s{k}"
        rows.append((k, " ".join(text), "en", "a", 1))
    rows += [(100 + k, " ".join(text), "en", "a", 1) for k in range(400)]
    got = {r[0]: r[2] for r in rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)))}
    assert got == brute(rows[:25]) | {k: 0 for k in range(100, 500)}


def test_one_of_each_keeps_columns(spark, awkward, nothing):
    df = clashing(awkward)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert 6 in ids and not {7, 8, 9} & set(ids) and {1, 2, 3, 10} <= set(ids)
    assert ngram_join.one_of_each(nothing).count() == 0
    assert ngram_join.near_duplicates(nothing).count() == 0
