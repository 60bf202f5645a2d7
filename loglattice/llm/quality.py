"""Quality rules as a bitmask ledger (DataFrame functions only).

Each rule is evaluated once for each document; its failure is one bit of
``fail_bits`` and its inputs are kept as measurements.  A policy is a versioned
mask over those bits, so policies are applied, compared and ablated from the
ledger alone, by bitwise aggregation, without touching the texts again.

Defined results: null text counts as empty; an empty text has no words, fails
``few_words`` and has zero measurements; repeated rows are judged one by one;
null identifiers pass through; other columns of the input are ignored by
:func:`ledger` (names that clash with the ledger's own don't matter).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
WINDOW = 8

#: Rule names in the order of their bits.
RULES = ("few_words", "repeated_windows", "symbol_ratio", "word_length", "duplicate_lines", "shouting")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(rule) for rule in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("2024-1", RULES)


def _failures() -> list[Column]:
    """Conditions under which the rules fail, over the measurements."""
    words = F.col("n_words")
    return [
        words < 20,
        100 * F.col("n_repeat_words") > 30 * words,
        3 * F.col("n_symbols") > words,
        (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words),
        2 * F.col("n_dup_lines") > F.col("n_lines"),
        2 * F.col("n_upper") > F.col("word_chars"),
    ]


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every whole text, without a shuffle.

    ``n_repeat_words`` counts words inside windows of eight words that occur at
    least twice in the text.  Windows are compared by 64-bit hash within one
    text; the costly part runs only for texts in which some window repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = df.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    step = step.withColumn("w", F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), ""))
    step = step.withColumn("l", F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    step = step.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    step = step.withColumn(
        "win",
        F.when(
            F.size("h") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("h") - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col("h"), i, WINDOW))),
        ),
    )
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    step = step.withColumn(
        "s", F.when(repeats, F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    )
    like = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    places = F.transform("s", lambda x, k: F.when(like(x, k - 1) | like(x, k + 1), x["p"]))
    step = step.withColumn("p", F.sort_array(F.array_compact(places)))
    covered = F.transform("p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1), p + WINDOW) - p))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper")
    row = F.struct(*counts, F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"))
    # A filter on the measurements stays above the generator: pushed below it, each lambda would work out whole arrays anew for each element.
    return step.select("doc_id", F.inline(F.array(row)))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` (bit k: rule k of :data:`RULES` failed)."""
    bits = [F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, fails in enumerate(_failures())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(df, id_col, text_col).withColumn("fail_bits", total)


def verdict(policy: Policy, bits: str = "fail_bits") -> Column:
    """True where the policy keeps the document."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many would be kept if only it were dropped.

    One pass over the ledger; counts are combined before the shuffle.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = []
    for rule in policy.rules:
        bit = F.lit(1 << RULES.index(rule)).cast("long")
        sums += [F.count_if(masked.bitwiseAND(bit) != 0).alias(f"failed_{rule}"), F.count_if(masked == bit).alias(f"only_{rule}")]
    row = book.agg(F.bit_or(masked).alias("seen_bits"), *sums)
    rows = [F.struct(F.lit(rule).alias("rule"), F.col(f"failed_{rule}").alias("failed"), F.col(f"only_{rule}").alias("only_this_rule")) for rule in policy.rules]
    return row.select(F.lit(policy.version).alias("version"), F.inline(F.array(*rows)))


def judge(df: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Ledger columns with ``base_failed`` and ``kept`` under ``policy``."""
    return ledger(df).withColumn("base_failed", ~verdict(BASE)).withColumn("kept", verdict(BASE) & verdict(policy))


def keep_documents(df: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of ``df`` that the policy keeps, all columns as they were, in one pass without a join."""
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), F.col("text"))
    return ledger(packed).filter(verdict(BASE) & verdict(policy)).select("doc_id.*")
