import random
from collections import Counter
from dataclasses import replace

import pytest
from cases import SCHEMA, clashing, prose, rows_of
from plain import fill, mix
from pyspark.sql import functions as F

from loglattice.llm import mixing

SMALL = mixing.Recipe(
    domains={"x": ("a", "b"), "y": ("c",)}, domain_weights={"x": 1, "y": 6, "other": 0}, lang_weights={"en": 3, "de": 1}, source_weights={"a": 2}, share=90, max_epochs=2, seed="s"
)


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


@pytest.mark.parametrize("recipe", [mixing.STANDARD, SMALL, replace(SMALL, share=400), replace(SMALL, share=7, max_epochs=1), replace(SMALL, lang_weights={"en": 3, "de": 0}, source_weights={"b": 0})])
def test_matches_plain_version(spark, awkward_rows, recipe):
    df = spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)
    got = rows_of(mixing.mix(clashing(df), recipe).select("doc_id", "lang", "source", "copies"))
    want = [(r[0], r[2], r[3], n) for r, n in zip(awkward_rows, mix(awkward_rows, recipe), strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_shortage_goes_to_siblings_first():
    assert fill(100, [("a", 10, 1), ("b", 500, 1)]) == {"a": 10, "b": 90}
    assert fill(100, [("a", 10, 1), ("b", 20, 1)]) == {"a": 10, "b": 20}


def test_children_without_weight_are_no_capacity(spark):
    """What a domain can't use, since most of it has weight 0, goes to the other domain."""
    rows = [(k, "one two three four five six seven eight nine ten", "en" if k == 0 else "de", "a", 1) for k in range(10)]
    rows += [(100 + k, "one two three four five six seven eight nine ten", "en", "c", 1) for k in range(10)]
    recipe = mixing.Recipe(domains={"x": ("a",), "y": ("c",)}, domain_weights={"x": 1, "y": 1}, lang_weights={"de": 0}, share=60, max_epochs=1)
    got = {(r[1], r[2]): r[4] for r in rows_of(mixing.mix(spark.createDataFrame(rows, SCHEMA), recipe).groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("copies")).alias("taken")).selectExpr("1", "source", "lang", "n", "taken"))}
    assert got == {("a", "en"): 10, ("a", "de"): 0, ("c", "en"): 100}


def test_documents_are_repeated_whole(spark, awkward, nothing):
    df = clashing(awkward)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = Counter({(r["doc_id"], r["n_tokens"]): 0 for r in mixing.mix(awkward).collect()})
    for r in mixing.mix(awkward).collect():
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in out.collect())
    assert all(got[k] == n for k, n in want.items() if not isinstance(k, tuple))
    assert mixing.mixed_documents(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_hot_source_meets_its_budget(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, 20), "en", "src0" if k % 3 else f"src{k % 30}", 1) for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).selectExpr("sum(n_tokens * copies) AS taken", "sum(n_tokens) AS all").first()
    assert 0.55 <= got["taken"] / got["all"] <= 0.6
