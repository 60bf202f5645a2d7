"""Filter interaction audit: what each filter removes in every order of the filters (DataFrame functions only).

The words of every text are exploded and counted by (document, word), then by
document, which gives totals and distinct words.  The other flags come from a
scan of their own without the texts in its shuffle, and an outer join brings them
together, so a document without words keeps its row.  Five flags make one of 32
sets; each part gets one conditional count for every set S of filters: the
documents that fail none of S.  What a filter removes after others is the
difference of two such counts, so all 120 orders follow from one row of counts
for each part, without touching the documents again.

Texts cross the shuffle once, dealt by document; counting by (document, word) and
by document then needs no other.  A text that a third of the documents share is one
combined row in the search for earlier copies, and the join that brings its first id
back is an outer join whose large partitions Spark splits.

Defined results: null text is empty and fails A; null ids take no part in E and have
no labels; repeated rows count each, and a row isn't a copy of its like with the
same id; a null source is the part ''; several labels of a document count as 1
where any is 1; an empty table gives no row; other columns are not read.  Texts
and words are compared by 128-bit and (within a document) 64-bit hashes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
SPACE = "\\x20\\x09-\\x0D"


def _pair(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of the same columns."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def _keyed(docs: DataFrame) -> DataFrame:
    text, part = F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))
    one, two = _pair(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("part"), F.col("text"))
    return rows.withColumns({"k1": one, "k2": two})


def word_counts(keyed: DataFrame) -> DataFrame:
    """``k1, k2, words, distinct_words`` of every key with a word; equal rows are counted together."""
    words = F.transform(F.array_remove(F.split("text", f"[{SPACE}]+"), ""), lambda w: F.xxhash64(w))
    dealt = keyed.select("k1", "k2", "text").repartition("k1", "k2")
    by_word = dealt.select("k1", "k2", F.explode(words).alias("word")).groupBy("k1", "k2", "word").agg(F.count(F.lit(1)).alias("n"))
    return by_word.groupBy("k1", "k2").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each distinct (id, part, text): ``part, copies, failed`` (bit k: filter k fails), ``good, toxic``."""
    keyed = _keyed(docs)
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    one, two = _pair(F.col("text"))
    facts = keyed.select("k1", "k2", "doc_id", "part", one.alias("t1"), two.alias("t2"), (100 * capitals > 5 * F.length("text")).alias("shouts"), F.col("text").rlike("[#$%&*|]").alias("marked"))
    whole = facts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "part", "t1", "t2", "shouts", "marked")])
    rows = whole.join(word_counts(keyed), ["k1", "k2"], "left")
    earliest = facts.groupBy("t1", "t2").agg(F.min("doc_id").alias("earliest"), F.count(F.lit(1)).alias("holders")).filter("holders > 1").drop("holders")
    rows = rows.join(earliest, ["t1", "t2"], "left")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(known, "doc_id", "left")
    words, distinct = (F.coalesce(c, F.lit(0)) / F.col("copies") if c == "words" else F.coalesce(c, F.lit(0)) for c in ("words", "distinct_words"))
    fails = [words < 50, 100 * distinct < 65 * words, F.col("shouts"), F.col("marked"), F.coalesce(F.col("doc_id") > F.col("earliest"), F.lit(False))]
    failed = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    return rows.select("part", "copies", failed.alias("failed"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _orders() -> Column:
    """Every order of the filters with its steps: the order, the step, its filter, and the sets of filters before and up to it."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append((f"'{''.join(FILTERS[x] for x in order)}'", step, k, before, before | 1 << k))
            before |= 1 << k
    rows = ", ".join(f"named_struct('filter_order', {a}, 'step', {b}, 'k', {c}, 'before', {d}, 'upto', {e})" for a, b, c, d, e in steps)
    return F.expr(f"inline(array({rows}))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by part, order and step."""
    seen = flags(docs, labels).groupBy("part", "failed").agg(F.sum("copies").alias("n"), *[F.sum(F.col("copies") * F.col(c)).alias(c) for c in ("good", "toxic")])
    of = lambda c, s: F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) == 0, F.col(c)).otherwise(0))
    shares = {k: F.sum(F.when(F.col("failed").bitwiseAND(F.lit(1 << k)) != 0, F.col("n") * F.element_at(F.lit([120, 60, 40, 30, 24]), F.bit_count("failed"))).otherwise(0)) for k in range(len(FILTERS))}
    lists = {"n": "clean", "good": "clean_good", "toxic": "clean_toxic"}
    parts = seen.groupBy("part").agg(*[F.array(*[of(c, s) for s in SETS]).alias(name) for c, name in lists.items()], F.array(*shares.values()).alias("shares"))
    rows = parts.select("part", *lists.values(), "shares", _orders())
    at = lambda name, place: F.get(name, place)
    one = F.expr("shiftleft(1, k)")
    lost = lambda name: at(name, F.col("before")) - at(name, F.col("upto"))
    columns = {
        "kept": at("clean", F.col("upto")),
        "removed": lost("clean"),
        "redundant": at("clean", F.lit(0)) - at("clean", one) - lost("clean"),
        "unique_fails": at("clean", F.lit(len(SETS) - 1) - one) - at("clean", F.lit(len(SETS) - 1)),
        "good_lost": lost("clean_good"),
        "toxic_lost": lost("clean_toxic"),
        "shapley": at("shares", F.col("k")),
    }
    return rows.select("part", "filter_order", "step", *[x.cast("long").alias(name) for name, x in columns.items()])
