"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

Sources hang in a tree: domain, language, source.  A token budget enters at the
root and is dealt level by level in proportion to the weights of the children,
but no child gets more than it can give (its tokens times ``max_epochs``).  What
a child can't use goes to its siblings first; only when a whole node is short
does its parent see the shortage and pass it to the node's siblings.  Each leaf
then takes whole epochs and a token prefix of one more, in an order seeded for
that leaf's epoch.

All amounts are integers, so results don't depend on the order of sums.  The
prefix of a leaf isn't found by sorting the leaf: tokens are summed by the first
three hex digits of the seeded hash, and only the one bucket in which the prefix
ends is looked at row by row.  The plan has one row for each leaf.

Defined results: tokens are words ``[^\\x20\\x09-\\x0D]+``; null or empty text
has none; a null language or source is a leaf of its own; names without a
weight get the default weight; a weight of zero takes nothing; rows with equal
ids stand or fall together; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm import storage

LEVELS = ("domain", "lang", "source")
_WIDE = "decimal(19,0)"


@dataclass(frozen=True)
class Recipe:
    """Integer weights by name at each level, and which sources form a domain."""

    domains: dict[str, tuple[str, ...]]
    domain_weights: dict[str, int]
    lang_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)
    default_domain: str = "other"
    default_weight: int = 1
    share: int = 60  # per cent of all tokens
    max_epochs: int = 4
    seed: str = "mix-1"


STANDARD = Recipe(
    domains={"web": tuple(f"src{i}" for i in range(10)), "books": tuple(f"src{i}" for i in range(10, 15)), "forums": tuple(f"src{i}" for i in range(15, 19))},
    domain_weights={"web": 50, "books": 30, "forums": 15, "other": 5},
    lang_weights={"en": 40, "de": 20, "fr": 20, "es": 20},
    source_weights={"src0": 3},
)


def tokens(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _lookup(name: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("long")


def _domain(recipe: Recipe) -> Column:
    out = F.lit(recipe.default_domain)
    for name, sources in recipe.domains.items():
        out = F.when(F.col("source").isin(*sources), F.lit(name)).otherwise(out)
    return out


def _deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``alloc`` of every node: its share of its parent's ``budget`` under its capacity ``cap`` and weight ``w``.

    Children are filled in the order of cap / w; a child is full if its cap
    fits into its share of what the children before it left over.
    """
    wide = lambda c: F.col(c).cast(_WIDE)
    nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)))
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(-1.0)), F.col(name).asc_nulls_first())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumns({"before": before, "after": after})
    nodes = nodes.withColumn("full", wide("cap") * wide("after") <= wide("w") * (F.col("budget") - F.col("before")).cast(_WIDE))
    every = Window.partitionBy(*parent)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(every)
    weight = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(every)
    nodes = nodes.withColumns({"taken": taken, "weight": weight})
    share = F.floor(wide("w") * (F.col("budget") - F.col("taken")).cast(_WIDE) / wide("weight")).cast("long")
    return nodes.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("before", "after", "full", "taken", "weight", "budget")


def allocate(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """``leaves(domain, lang, source, supply)`` with ``alloc`` tokens each.

    A leaf of weight zero, or below such a node, takes nothing, so it is no
    capacity of the nodes above it and their shortage goes to their siblings.
    """
    weights = [_lookup(F.col(level), table, recipe.default_weight) for level, table in zip(LEVELS, (recipe.domain_weights, recipe.lang_weights, recipe.source_weights), strict=True)]
    leaves = leaves.withColumn("cap", F.when(F.least(*weights) > 0, F.col("supply") * recipe.max_epochs).otherwise(0))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    root = domains.agg(F.least(F.floor(F.sum("supply") * recipe.share / 100), F.sum("cap")).cast("long").alias("budget"))
    domains = domains.withColumn("w", _lookup(F.col("domain"), recipe.domain_weights, recipe.default_weight))
    top = _deal(domains.crossJoin(F.broadcast(root)), [], "domain").select("domain", F.col("alloc").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    langs = langs.withColumn("w", _lookup(F.col("lang"), recipe.lang_weights, recipe.default_weight)).join(top, "domain")
    mid = _deal(langs, ["domain"], "lang").select("domain", F.col("lang").alias("lang_"), F.col("alloc").alias("budget"))
    low = leaves.withColumn("w", _lookup(F.col("source"), recipe.source_weights, recipe.default_weight))
    low = low.join(mid, (low["domain"] == mid["domain"]) & low["lang"].eqNullSafe(mid["lang_"])).drop(mid["domain"]).drop("lang_")
    return _deal(low, ["domain", "lang"], "source").drop("w")


def _seeded(recipe: Recipe) -> Column:
    """The seeded order of a document in its leaf's last epoch."""
    return F.md5(F.concat_ws(":", F.lit(recipe.seed), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _leaf_join(rows: DataFrame, plan: DataFrame) -> DataFrame:
    same = rows["domain"] == plan["domain"]
    for level in LEVELS[1:]:
        same = same & rows[level].eqNullSafe(plan[level])
    return rows.join(plan, same).drop(*[plan[level] for level in LEVELS])


def plan(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """One row for each leaf: supply, alloc, whole epochs and the last seeded hash of the prefix.

    ``rows`` has doc_id, the levels and n_tokens, and is read three times.
    """
    leaves = allocate(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), recipe)
    leaves = leaves.withColumn("epochs", F.when(F.col("supply") > 0, F.expr("alloc div supply")).otherwise(F.lit(0)))
    leaves = leaves.withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("supply"))
    leaves = storage.settle(leaves.coalesce(1), "mix-leaves")
    keyed = _leaf_join(rows, leaves.select(*LEVELS, "epochs", "rest").filter("rest > 0")).withColumn("h", _seeded(recipe)).withColumn("b", F.substring("h", 1, 3))
    sums = keyed.groupBy(*LEVELS, "rest", "b").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("b")
    sums = sums.withColumn("upto", F.sum("n").over(upto))
    edge = sums.filter(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(F.min_by(F.struct("b", (F.col("upto") - F.col("n")).alias("before")), "b").alias("edge")).select(*LEVELS, "edge.*")
    edge = storage.settle(edge.withColumnRenamed("b", "edge_b").coalesce(1), "mix-edges")
    inside = _leaf_join(keyed, edge).filter(F.col("b") == F.col("edge_b"))
    inside = inside.withColumn("cum", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("h")))
    last = inside.filter(F.col("cum") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("h").alias("last_h"))
    cut = edge.alias("e").join(last.alias("l"), F.expr(" AND ".join(f"e.{c} <=> l.{c}" for c in LEVELS)), "left").select(*[F.col(f"e.{c}").alias(c) for c in LEVELS], F.coalesce("last_h", "edge_b").alias("cutoff"))
    done = leaves.alias("p").join(cut.alias("c"), F.expr(" AND ".join(f"p.{c} <=> c.{c}" for c in LEVELS)), "left").select("p.*", "cutoff")
    return storage.settle(done.coalesce(1), "mix-plan")


def narrow(df: DataFrame, recipe: Recipe) -> DataFrame:
    """doc_id, the levels and n_tokens of every row, written out so that texts are counted once."""
    rows = df.select(F.col("doc_id"), _domain(recipe).alias("domain"), "lang", "source", tokens(F.col("text")).alias("n_tokens"))
    return storage.settle(rows, "mix-rows")


def copies(rows: DataFrame, leaf_plan: DataFrame, recipe: Recipe) -> DataFrame:
    """``rows`` (with the levels) and how often each is taken."""
    joined = _leaf_join(rows, leaf_plan.select(*LEVELS, "epochs", "cutoff"))
    return joined.withColumn("copies", (F.col("epochs") + F.when(_seeded(recipe) <= F.col("cutoff"), F.lit(1)).otherwise(F.lit(0))).cast("long")).drop("epochs", "cutoff")


def mix(df: DataFrame, recipe: Recipe = STANDARD) -> DataFrame:
    """doc_id, levels, n_tokens and copies of every document."""
    rows = narrow(df, recipe)
    return copies(rows, plan(rows, recipe), recipe)


def mixed_documents(df: DataFrame, recipe: Recipe = STANDARD) -> DataFrame:
    """The rows of ``df``, each as often as the mixture takes it."""
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id"), _domain(recipe).alias("domain"), "lang", "source")
    taken = copies(rows, plan(narrow(df, recipe), recipe), recipe).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
