import random

from cases import SCHEMA, clashing, rows_of
from plain import drop_lines
from pyspark.sql import functions as F

from loglattice.llm import linededup


def pages(rng, n=120):
    rows = []
    for k in range(n):
        host = rng.choice(["a", "a", "a", "b", None])
        lines = [f"own {k} {j}" for j in range(rng.randrange(0, 5))]
        lines += [f" Accept  cookies\t"] * rng.randrange(0, 3) + ([f"menu of {host}"] if rng.random() < 0.4 else []) + ["", " "] * rng.randrange(0, 2)
        lines += ["at the ratio"] if k % 10 == 0 else []
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", host, 1))
    return rows + [(500, None, "en", "a", 7), (501, "", "en", "b", 0), (501, "", "en", "b", 0)]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_matches_plain_version(spark):
    rows = pages(random.Random(4))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rows_of(linededup.drop_boilerplate(df, host="source", length="n_chars"))
    assert sorted(got, key=key) == sorted(drop_lines(rows), key=key)
    assert any("menu" in (r[1] or "") for r in rows) and not any("menu of a" in (r[1] or "") for r in got)


def test_extra_columns_and_counts(spark):
    rows = pages(random.Random(8), 40)
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = linededup.drop_boilerplate(df, host="source", counts=True)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    for row in got.filter("text IS NOT NULL").collect():
        assert row["n_lines"] - row["n_dropped"] == (row["text"].count("\n") + 1 if row["text"] or row["n_lines"] > row["n_dropped"] else 0)


def test_hot_host_and_empty_table(spark, nothing):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("footer\nline "), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = linededup.drop_boilerplate(df, host="source")
    assert got.filter("source = 'hot' AND text LIKE 'footer%'").count() == 0
    assert got.filter("text LIKE 'footer%'").count() == 1000
    assert linededup.drop_boilerplate(nothing, host="source").count() == 0


def test_host_of_urls(spark):
    urls = [("https://User:x@Example.COM:8080/a?b#c", "example.com"), ("http://a.b", "a.b"), ("nothing", ""), (None, None)]
    got = spark.createDataFrame(urls, "url string, want string").select(linededup.host_of(F.col("url")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
