import random
from collections import Counter

import public_tokenizers
from cases import SCHEMA, clashing, prose
from plain import components, drop_lines, mix, quality
from tokenizers import Tokenizer

import corpus_pipeline
from loglattice.llm import mixing, tokens


def corpus():
    rng = random.Random(12)
    rows = []
    for k in range(160):
        text = prose(rng, rng.randrange(10, 120), 3000)
        if k % 5 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if k % 7 == 0:
            text += "\nshare this page with friends\n"
        rows.append((k, text, rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src0", "src3", "src12", "zzz"]), len(text)))
    return [*rows, (300, None, "en", "src0", 0), (301, "", "en", "src0", 0), (302, "x " * 400, "en", "src0", 800)]


def plain_pipeline(rows):
    rows = drop_lines([r for r in rows if quality(r[1])[-1]])
    roots = components(rows)
    rows = [r for r in rows if roots[r[0]] == r[0]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    out = Counter()
    for row, copies in zip(rows, mix(rows, mixing.STANDARD), strict=True):
        out[row[0]] += copies * (len(tokenizer.encode(row[1], add_special_tokens=False).ids) + 1)
    return +out


def test_pipeline_matches_plain_version(spark, tmp_path):
    rows = corpus()
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder))
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
    assert got == plain_pipeline(rows) and len(got) > 40


def test_stages_keep_the_columns(spark):
    docs = clashing(spark.createDataFrame(corpus()[:30], SCHEMA))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name


def test_stages_take_an_empty_table(spark, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0, name
