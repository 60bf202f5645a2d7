"""Documents with every awkward case, and words taken as the contracts take them."""

from __future__ import annotations

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def lowered(text):
    """ASCII letters in lower case."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empty, blank and long texts, copies, near copies, other alphabets and white space."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    near = base.copy()
    near[60] = "changed"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t \x0b", "en", None, 5), (4, "one two", "de", "a", 7), (5, "One  TWO", None, "b", 8),
        (6, " ".join(base), "en", "a", 1), (7, " ".join(base), "en", "b", 1), (8, " ".join(near), "en", "b", 1), (9, "\n".join(base).upper(), "en", "b", 1),
        (10, prose(rng, 6000), "fr", "a", 1), (11, "été ÉTÉ x ñandú 東京 都\n東京 都\n\n東京 都", "es", "c", 1), (12, "a b c d e " * 30, "en", "c", 1),
        (None, "no id here at all", "en", "a", 1), (13, "same row twice", "en", "a", 1), (13, "same row twice", "en", "a", 1),
        (14, "SHOUT " * 30, "en", "a", 1), (15, "<|endoftext|> mark <|startoftext|> ★ ☆", "en", "a", 1), (16, "#$% ** & | <b> " * 9, "en", "a", 1),
    ]
    rows += [(20 + k, prose(rng, rng.randrange(1, 90)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "src0", "src12"]), 1) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """``df`` with more columns, named like inner ones of the operators."""
    from pyspark.sql import functions as F

    names = ["h", "n", "t", "w", "key", "row", "band", "shard", "block", "copies", "kept", "line", "term", "id", "a.b"]
    return df.withColumns({name: F.lit(1) for name in names})


def rows_of(df):
    return [tuple(r) for r in df.collect()]
