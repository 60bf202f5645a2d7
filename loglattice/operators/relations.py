"""Session relations: continuation chains and active branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_chains(nodes: DataFrame, edges: DataFrame, doublings: int = 5) -> DataFrame:
    """``node, target, hops``: where following ``edges(src, dst)`` ends, in ``2 ** doublings`` hops at most.

    Edges to missing nodes and to the node itself are no edges; of several
    edges of a node the smallest target counts.  Jumps double in every round,
    so 32 hops take five joins.  A walk that comes back to a node it has been
    at stops at the last new one; a walk that is longer stops at its last hop.
    """
    known = nodes.select("node").distinct()
    valid = edges.filter("src <> dst").join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    step = valid.groupBy("src").agg(F.min("dst").alias("dst"))
    start = known.join(step, F.col("node") == F.col("src"), "left").select("node", F.array("node").alias("path"), "dst")
    # The path of a walk, doubled: each round appends the path of the node where the next hop leads.
    walks = start.select("node", "path", F.col("dst").alias("next"))
    for _ in range(doublings):
        further = walks.select(F.col("node").alias("next"), F.col("path").alias("_more"), F.col("next").alias("_next"))
        walks = walks.join(further, "next", "left").select("node", F.concat("path", F.coalesce("_more", F.array().cast(walks.schema["path"].dataType))).alias("path"), F.col("_next").alias("next"))
    # At most 2 ** doublings + 1 places: the node itself, then one for each hop.
    most = 2**doublings
    walks = walks.withColumn("path", F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path"))).withColumn("path", F.slice("path", 1, most + 1))
    again = F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_position("path", F.get("path", i - 1)) < i)
    steps = F.coalesce(F.get(again, 0) - 2, F.size("path") - 1)
    return walks.select("node", F.get("path", steps).alias("target"), steps.cast("int").alias("hops"))


def active_branch(entries: DataFrame) -> DataFrame:
    """The entries on the path from each session's last entry to its root.

    ``entries(session, pos, id, parent_id)``.  A session with an entry that has
    no id keeps file order, i.e. all its entries; an empty table gives none.  A
    missing parent ends the path, and so does a cycle.  Reachability doubles:
    after round k every marked entry has marked its ancestors up to ``2 ** k``
    steps away; rounds go on until none adds a mark, so a branch may have any
    length.
    """
    plain = entries.groupBy("session").agg(F.bool_or(F.col("id").isNull()).alias("_flat"), F.max_by("id", "pos").alias("_leaf"))
    nodes = entries.filter("id IS NOT NULL").groupBy("session", "id").agg(F.max_by("parent_id", "pos").alias("up"))
    parents = nodes.select("session", F.col("id").alias("up")).distinct()
    jump = nodes.join(parents, ["session", "up"], "left_semi").select("session", "id", "up")
    marked = plain.filter("NOT _flat").select("session", F.col("_leaf").alias("id"))
    before = -1
    while True:
        marked = marked.union(marked.join(jump, ["session", "id"]).select("session", F.col("up").alias("id"))).distinct()
        more = jump.select("session", F.col("id").alias("up"), F.col("up").alias("_to"))
        jump = jump.join(more, ["session", "up"]).select("session", "id", F.col("_to").alias("up"))
        marked, jump = marked.checkpoint(), jump.checkpoint()
        count = marked.count()
        if count == before:
            break
        before = count
    flat = plain.filter("_flat").select("session")
    return entries.join(marked, ["session", "id"], "left_semi").unionByName(entries.join(flat, "session", "left_semi").select(*entries.columns))
