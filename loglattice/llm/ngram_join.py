"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles.  Two sets link at a
Jaccard similarity of 0.75, that is when seven times their symmetric difference
is at most the sum of their sizes.

1. One pass over the texts makes, for each document, a 128-bit fingerprint of
   the set and, for each of its size bands, the keys of its sketch parts and a
   parity bit sketch (:mod:`loglattice.llm.shingles`).  Documents with equal sets
   form a class, which goes on as one node.
2. Linked sets lie in a common size band and differ in so few tokens that some
   sketch part is equal, so they share a key.  The member of each bucket of equal
   keys that shares most keys altogether is its leader, found by combined sums
   and maxima.
3. In each of ``WAVES`` waves every node meets one leader of another component,
   that of its heaviest open bucket, so a wave makes one pair for a node at most.
   A pair goes on if the Hamming distance of the bit sketches, a lower bound of
   the symmetric difference, allows a link; then the exact sets decide.  The
   links are contracted to components, and a bucket whose members all fell into
   one component is closed.
4. In the buckets that are still open, the members outside the bucket's largest
   component meet the members of other components.  The rows carry the bit
   sketches, and only pairs that these leave possible come out; the exact sets
   decide again.

So copies and near copies never expand into all their pairs, and yet every pair
that shares a key is tested or already known to be connected.

The candidate search is probabilistic: parts are few enough to be joined on and
hold about four tokens each, so a pair at exactly 0.75 has each part equal with a
chance of 0.32, and misses all 64 with a chance of about 2e-11, less at higher
similarity.  ``parts=None`` is exact: its parts of one token are so many, about a
quarter of the set, that linked sets share one for certain.  Sets in bands above 900 shingles are compared by a sketch of about 900 sampled
tokens, with a bound that a link exceeds with a chance of about 1e-9, and then by
the whole sketch.

Defined results: null, empty or blank text has an empty set, links with nothing
and is its own component; a text of one to four words has one shingle, its
whole sequence; repeated rows give a row each; a null id counts as larger than
any other, and a component without ids is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm import graph, shingles, storage
from loglattice.llm.textkit import mix64, small_batches

_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)
#: Rounds in which every node meets one leader.
WAVES = 2
#: Shingles that one chunk of the exact comparison may hold beside its leader's.
CHUNK = 1 << 20

WORDS = [f"s{k}" for k in range(shingles.SAMPLE_WORDS)]
_SIDES = f"array<struct<band:int,keys:array<long>,{','.join(f'{c}:long' for c in WORDS)}>>"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *rows])))


def features(docs: DataFrame, parts: int | None = shingles.PARTS) -> DataFrame:
    """``doc_id, text_key, n, f1, f2`` of every document, for each of its bands keys and bit sketch (``sides``), and the whole sketch of large sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in shingles.sets_of(small_batches(batches, "text")):
            sizes, one, two, whole, sides, band_of = [], [], [], [], [0], []
            keys, samples = [np.zeros(0, dtype=np.int64)], []
            for found in sets:
                some = len(found) > 0
                sizes.append(len(found))
                one.append(int(np.bitwise_xor.reduce(found).astype(np.int64)) if some else 0)
                two.append(int(np.bitwise_xor.reduce(mix64(found ^ _OTHER)).astype(np.int64)) if some else 0)
                held = shingles.bands(len(found)) if some else ()
                whole.append(shingles.parity(found) if any(shingles.sample_rate(b) < 1 for b in held) else np.zeros(0, dtype=np.int64))
                for band in held:
                    band_of.append(band)
                    keys.append(shingles.part_keys(found, band, parts))
                    samples.append(shingles.sample_sketch(found, band))
                sides.append(len(band_of))
            cuts = pa.array(np.cumsum([len(k) for k in keys]), pa.int32())
            held = np.stack(samples) if samples else np.zeros((0, len(WORDS)), dtype=np.int64)
            fields = [pa.array(band_of, pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(keys)))]
            fields += [pa.array(np.ascontiguousarray(held[:, k])) for k in range(len(WORDS))]
            struct = pa.StructArray.from_arrays(fields, names=["band", "keys", *WORDS])
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, one, two)), _lists(whole), pa.ListArray.from_arrays(pa.array(sides, pa.int32()), struct)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "f1", "f2", "sketch", "sides"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id long, text_key long, n long, f1 long, f2 long, sketch array<long>, sides {_SIDES}")


def _near(a: str, b: str) -> Column:
    """Whether the set sizes alone allow a link."""
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b)) & (F.col(a) > 0)


def _hamming(a: str, b: str) -> Column:
    """Hamming distance of two parity sketches; near sizes differ by one folding at most."""
    short = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda c: F.when(F.size(c) > short, F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), xor)).otherwise(F.col(c))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda acc, x: acc + x)


def _possible(a: str, b: str) -> Column:
    """Whether the bit sketches of a common band leave a link possible.

    A link differs in at most a seventh of the summed sizes.  Where the band
    keeps all tokens that bounds the distance; of a sample's 1024 bits, each
    differs with chance (1 - exp(-2 m / 1024)) / 2 for m differing tokens in it,
    and six standard deviations are added.
    """
    apart = sum((F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in WORDS), F.lit(0))
    most = (F.col(f"{a}_n") + F.col(f"{b}_n")) / 7
    bits = 64.0 * len(WORDS)
    share = (1 - F.exp(most * F.col("rate") * (-2 / bits))) / 2
    return apart <= F.when(F.col("rate") < 1, bits * share + 6 * F.sqrt(bits * share * (1 - share))).otherwise(most)


def _rate(band: str = "band") -> Column:
    """Share of the tokens that a band's bit sketch holds, from its largest size."""
    edges = F.array(*[F.lit(shingles.sample_rate(k)) for k in range(len(shingles.EDGES) - 1)])
    return F.element_at(edges, F.col(band) + 1)


def _named(sides: DataFrame, name: str, *keys: str) -> DataFrame:
    """``sides`` with its node called ``name`` and its size and sketch named after it; ``keys`` stay."""
    return sides.select(F.col("id").alias(name), *keys, F.col("n").alias(f"{name}_n"), *[F.col(c).alias(f"{name}_{c}") for c in WORDS])


def _exact_filter(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose exact sets link.

    Sets are made anew for the documents named in pairs only.  The first
    document's set goes with its pair, the second's once to each chunk of its
    pairs; a chunk holds at most about ``CHUNK`` shingles.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in shingles.sets_of(small_batches(batches, "text")):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "set"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = []
        if left.num_rows and right.num_rows:
            own = np.frombuffer(right.column("sb")[0].as_buffer(), dtype=np.uint64)
            for other in left.column("sa"):
                x = np.frombuffer(other.as_buffer(), dtype=np.uint64)
                both = np.concatenate([x, own])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(shingles.linked(len(x), len(own), len(both) - 2 * common))
        keep += [False] * (left.num_rows - len(keep))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.select("a", "b").distinct().filter("a <> b")
    wide = reps.select("id", "n", "sketch")
    sized = pairs.join(wide.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(wide.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    known = (F.size("sa") > 0) & (F.size("sb") > 0)
    sized = storage.settle(sized.filter(_near("na", "nb") & F.when(known, 7 * _hamming("sa", "sb") <= F.col("na") + F.col("nb")).otherwise(True)).select("a", "b", "na"), "possible")
    named = sized.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(reps.select("id", "doc_id", "text_key"), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), "text")
    texts = named.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).select("id", "text")
    table = storage.settle(texts.mapInArrow(sets, "id long, set binary").dropDuplicates(["id"]), "shingle-sets")
    chunks = sized.groupBy("b").agg(F.ceil(F.sum("na") / CHUNK).cast("int").alias("chunks"))
    dealt = sized.join(chunks, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"))
    one = dealt.join(table.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    two = chunks.select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part")).join(table.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").withColumnRenamed("b", "lead")
    links = storage.settle(one.groupBy("b", "chunk").cogroup(two.groupBy("lead", "part")).applyInArrow(compare, "a long, b long"), "links")
    storage.forget(sized, table)
    return links


def _wave(placed: DataFrame, sides: DataFrame) -> DataFrame:
    """One pair ``(a, b)`` at most for each node: it and the leader, in another component, of its heaviest bucket.

    ``placed`` has the members of open buckets: key, id, n, band, weight, root.
    """
    lead = F.max(F.struct("weight", (-F.col("id")).alias("lead"), F.col("n").alias("lead_n"), F.col("root").alias("lead_root"))).alias("best")
    met = placed.join(placed.groupBy("key").agg(lead), "key").filter((F.col("best.lead_root") != F.col("root"))).withColumn("lead_n", F.col("best.lead_n")).filter(_near("n", "lead_n"))
    chosen = met.groupBy("id").agg(F.max(F.struct("best.weight", "best.lead", "band")).alias("best")).select(F.col("id").alias("a"), (-F.col("best.lead")).alias("b"), "best.band")
    joined = chosen.join(_named(sides, "a", "band"), ["a", "band"]).join(_named(sides, "b", "band"), ["b", "band"])
    return joined.withColumn("rate", _rate()).filter(_possible("a", "b")).select("a", "b")


def _rest(placed: DataFrame, sides: DataFrame) -> DataFrame:
    """The possible pairs ``(a, b)`` of different components in the same open bucket."""
    held = storage.settle(placed.select("key", "id", "band", "root").join(sides, ["id", "band"]).withColumn("rate", _rate()).drop("band"), "open-members")
    main = held.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    outside = _named(held.join(main, "key").filter("root <> main"), "a", "key", "main", "rate", F.col("root").alias("ra"))
    inside = _named(held, "b", F.col("key").alias("bucket"), F.col("root").alias("rb"))
    apart = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
    return outside.join(inside, (F.col("key") == F.col("bucket")) & apart & _near("a_n", "b_n") & _possible("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component's root."""
    placed = members.join(graph.components(links), F.col("id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "id"))
    return placed.join(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"), "key")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between nodes that connect every component; ``reps`` holds a document's features for each node."""
    sides = reps.select("id", "n", F.explode("sides").alias("side"))
    keyed = sides.select("id", (F.col("n") * 64 + F.col("side.band")).alias("size_band"), F.explode("side.keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    counted = storage.settle(keyed.join(sizes, "key"), "members")
    members, weight = counted, counted.groupBy("id").agg(F.sum("size").alias("weight"))
    members = members.join(weight, "id").select("key", "id", F.floor(F.col("size_band") / 64).alias("n"), (F.col("size_band") % 64).cast("int").alias("band"), "weight")
    sides = sides.join(weight.select("id"), "id").select("id", "n", "side.band", *[f"side.{c}" for c in WORDS])
    members, sides = storage.settle(members, "weighed-members"), storage.settle(sides, "member-sketches")

    found, placed = None, members.withColumn("root", F.col("id"))
    for wave in range(WAVES + 1):
        pairs = storage.settle(_wave(placed, sides) if wave < WAVES else _rest(placed, sides), "pairs")
        more = _exact_filter(pairs, reps, docs)
        storage.forget(pairs)
        found = more if found is None else found.unionByName(more)
        if wave < WAVES:
            before, placed = placed, storage.settle(_open(members if wave == 0 else placed.drop("root"), found), "open-buckets")
            storage.forget(*([before] if wave else [counted]))
    storage.forget(placed, members, sides)
    return found


def _rooted(docs: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """The features of all documents, and ``f1, f2, n, class_id, root, component_id`` of their classes."""
    table = storage.settle(features(docs, parts), "features")
    classes = table.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("class_id"), F.min_by("text_key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("text_key"))
    classes = storage.settle(classes.withColumn("id", F.coalesce("class_id", F.xxhash64("f1", "f2", "n"))), "classes")
    same = [F.col(f"c.{c}") == F.col(f"t.{c}") for c in ("f1", "f2", "n", "text_key")]
    reps = table.alias("t").join(classes.alias("c"), [*same, F.col("c.class_id").eqNullSafe(F.col("t.doc_id"))]).select("c.id", "t.doc_id", "t.text_key", "t.n", "t.sketch", "t.sides").dropDuplicates(["id"])
    roots = storage.settle(graph.components(storage.settle(links(docs, reps), "links")), "roots")
    rooted = classes.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    return table, rooted.join(rooted.groupBy("root").agg(F.min("class_id").alias("component_id")), "root").select("f1", "f2", "n", "class_id", "root", "component_id")


def near_duplicates(docs: DataFrame, parts: int | None = shingles.PARTS) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of every document.

    ``class_id`` is the smallest id with an equal set, ``component_id`` the
    smallest id reachable by links.
    """
    table, rooted = _rooted(docs, parts)
    joined = table.select("doc_id", "n", "f1", "f2").join(rooted, ["f1", "f2", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the near duplicates of another row.

    Of each component the row with the smallest id stays (then the smallest
    hash of its text); of equal such rows one stays.  Rows without words stay.
    """
    table, rooted = _rooted(docs, shingles.PARTS)
    joined = table.filter("n > 0").select("doc_id", "text_key", "n", "f1", "f2").join(rooted.select("f1", "f2", "n", "root"), ["f1", "f2", "n"])
    placed = storage.settle(joined.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies")), "placed-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = placed.groupBy("root").agg(F.min(first).alias("best"))
    judged = placed.join(best, "root").withColumn("kept", first == F.col("best"))
    marked = storage.settle(judged.filter("NOT kept OR copies > 1").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("kept").alias("_kept")), "marked-rows")
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"))
    same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
    alone = rows.join(marked, same, "left_anti").select("row")
    repeated = rows.join(marked.filter("_kept"), same, "left_semi").dropDuplicates(["d", "t"]).select("row")
    return alone.union(repeated).select("row.*")
