"""Personal data: pattern spans, and terms that the corpus shows to reveal them (DataFrame functions only).

Base spans come from four patterns.  The method then follows information-theoretic
sanitisation: from co-occurrence in whole documents, over the whole corpus, it
estimates how much a term tells about a protected entity (one concrete address,
number, ...).  A term is a disclosure risk if the entity is nearly certain given
the term, ``P(entity | term)`` at least ``certainty``, if the pointwise mutual
information reaches ``share`` of the entity's own information
``-log2 P(entity)``, and if that is no accident: the term or the entity stands in
at least ``support`` *distinct* surroundings in the documents that hold both, and
these surroundings times the mutual information reach ``evidence`` bits, so an
entity that many documents hold needs more of them.  Copies of a passage have
equal surroundings and count once.  Every occurrence of such a term becomes a
``term`` span, in documents without the entity too.

Patterns are written without nested repetition and start only at the beginning
of a run of their characters, so very long texts cost linear time and no deep
recursion; offsets are added up from the pieces between matches.

Shuffled are partial sums of term counts, the places of terms that hardly occur
outside documents with an entity (no other term can reach ``certainty``) and,
only if some term is a risk, the texts' keys; lookups are joined as written
tables whose size Spark sees.

Defined results: null text is empty and has no spans; repeated rows are reported
each; documents count once per (id, text) in the statistics; a null id is an id;
other columns are not read.  Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm import storage

#: Base kinds in the order of the report.
KINDS = ("email", "ip", "card", "phone")
SPACE = "\\x20\\x09-\\x0D"
_SPAN = "array<struct<m:string,s:int,e:int>>"


@dataclass(frozen=True)
class Thresholds:
    """Disclosure thresholds and the width of surroundings in characters and words."""

    support: int = 3
    certainty: float = 0.9
    share: float = 0.75
    evidence: float = 12.0
    shortest: int = 3
    reach_chars: int = 120
    reach_words: int = 6


STANDARD = Thresholds()
NAMES = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def _settle(df: DataFrame, name: str) -> DataFrame:
    """A settled table; its codec holds no memory outside the heap, which many small files would add up to."""
    return storage.settle(df, name, compression="zstd")


def _marked(text: Column, pattern: str) -> Column:
    """``text`` with the characters matching ``pattern`` replaced by U+0001, and U+0001 itself by U+0002."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01")


#: Elements of an array that one step of a scan grows by, and code points of a piece of text.
GROUP, PIECE = 256, 512


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once, however often ``make`` names it."""
    return F.get(F.transform(F.array(value), make), 0)


def _scan(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state after each element, in linear time.

    An array that grows by one in every step is copied in every step, so no step
    goes over more than ``GROUP`` states (and over one entry a group).
    """

    def group(state: Column, few: Column) -> Column:
        grow = lambda acc, x: _let(step(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))
        return F.aggregate(few, F.struct(state.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), grow)

    def whole(every: Column) -> Column:
        cuts = F.when(F.size(every) > 0, F.sequence(F.lit(0), F.floor((F.size(every) - 1) / GROUP).cast("int"))).otherwise(F.array().cast("array<int>"))
        begin = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        put = lambda acc, k: _let(group(acc["at"], F.slice(every, k * GROUP + 1, GROUP)), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(cuts, begin, put, lambda acc: F.flatten(acc["out"]))

    return _let(values, whole)


def _pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, so that a place in it is found without going over all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` up to ``end``, taken from its pieces; empty if ``end`` isn't after ``start``."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, F.greatest(F.lit(1), last - first + 1)), "")
    return F.when(end > start, F.substring(part, (start % PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _spans(text: Column, pattern: str, passes: Callable[[Column], Column]) -> Column:
    """Matches of ``pattern`` in ``text`` with their places."""

    def placed(found: Column, gaps: Column) -> Column:
        ends = _scan(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), F.lit(0), lambda at, x: at + x, "int")
        spans = F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("s"), e.alias("e")))
        return F.filter(spans, lambda x: passes(x["m"]))

    each = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(each, lambda found: _let(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda gaps: placed(found, gaps)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _email(text: Column) -> Column:
    shown = _marked(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])")
    local, label = r"[A-Za-z0-9._%+\x01-]", "[A-Za-z0-9-]"
    pattern = rf"(?:(?<!{local})|\G){local}++@{label}++\x01[A-Za-z0-9\x01-]++"
    return F.when(F.instr(text, "@") > 0, _let(shown, lambda t: _spans(t, pattern, lambda m: F.lit(True))))


def _ip(text: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    pattern = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    return F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(text, pattern, lambda m: m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")))


def _card(text: Column) -> Column:
    shown = _marked(text, "(?<=[0-9])[ -](?=[0-9])")

    def passes(m: Column) -> Column:
        digits = _digits(m)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))

    return F.when(text.rlike("[0-9][0-9 -]{11,}[0-9]"), _let(shown, lambda t: _spans(t, r"[0-9][0-9\x01]++", passes)))


def _phone(text: Column) -> Column:
    return F.when(text.rlike(r"\+[0-9]"), _spans(text, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15)))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def base_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, text_key`` and one array of spans (match, start, end) for each base kind."""
    rows = _texts(df, id_col, text_col)
    makers = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}
    found = rows.withColumns({kind: F.coalesce(makers[kind](F.col("text")), F.array().cast(_SPAN)) for kind in KINDS})
    # Behind a generator, so that no filter on the spans works them out once more.
    return found.select(F.inline(F.array(F.struct(*found.columns))))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _term(word: Column) -> Column:
    """A word in lower case without punctuation at its ends."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", ""))


def _terms(text: Column) -> Column:
    """The terms of a text, its words as :func:`_term` has them, in one pass over the text."""
    sign = rf"[^\p{{L}}\p{{N}}{SPACE}]"
    bare = F.regexp_replace(F.lower(text), rf"(?<![^{SPACE}]){sign}++|(?<=[\p{{L}}\p{{N}}]){sign}++(?![^{SPACE}])", "")
    return F.array_distinct(F.split(bare, f"[{SPACE}]+"))


def _mapped(kinds: tuple[str, ...], make: Callable[[str, Column], Column]) -> Column:
    """The spans of all kinds, in the order given, each passed to ``make`` with its kind."""
    return F.concat(*[F.transform(kind, lambda x: make(kind, x)) for kind in kinds])


def _mentions(spans: DataFrame, limits: Thresholds) -> DataFrame:
    """``doc, entity, around`` of every mention: its document and a hash of its surroundings."""
    width = limits.reach_words

    def around(x: Column) -> Column:
        left = _words(_between(F.col("pieces"), F.greatest(F.lit(0), x["s"] - limits.reach_chars), x["s"]))
        right = _words(_between(F.col("pieces"), x["e"], F.least(x["e"] + limits.reach_chars, F.col("n"))))
        return F.xxhash64(F.concat(F.slice(F.reverse(left), 1, width), F.slice(right, 1, width)))

    each = _mapped(KINDS, lambda kind, x: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(x["m"])).alias("entity"), around(x).alias("around")))
    held = spans.select("doc", *KINDS, F.inline(F.array(F.struct(_pieces(F.col("text")).alias("pieces"), F.length("text").alias("n")))))
    return held.select("doc", F.inline(each))


def _gaps(spans: Column, pieces: Column, n: Column) -> Column:
    """The texts before, between and after ``spans`` (sorted by start, overlaps allowed)."""
    reach = _scan(F.transform(spans, lambda x: x["e"]), F.lit(0), lambda at, e: F.greatest(at, e), "int")
    starts, ends = F.concat(F.array(F.lit(0)), reach), F.concat(F.transform(spans, lambda x: x["s"]), F.array(n))
    return _let(pieces, lambda p: F.zip_with(starts, ends, lambda a, b: _between(p, a, b)))


def _outside() -> Column:
    """The text with a blank for each base span."""
    every = F.sort_array(_mapped(KINDS, lambda kind, x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(_let(every, lambda spans: _gaps(spans, _pieces(F.col("text")), F.length("text"))), " ")


def _distinct_terms(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    return docs.select(*more, F.explode(_terms(F.col(text))).alias("term"))


def _candidates(docs: DataFrame, repeated: DataFrame, spans: DataFrame, limits: Thresholds) -> DataFrame:
    """``term, docs_term`` of the terms with enough of their documents among those with an entity.

    Documents are counted by term before anything is joined, so common words cost partial sums only.
    Words of the entities themselves are no terms of a document.
    """
    seen = _distinct_terms(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    extra = _distinct_terms(repeated, "extra").groupBy("term").agg(F.sum("extra").alias("x"))
    told = _distinct_terms(spans, text="outside").withColumns({"near": F.lit(1), "whole": F.lit(0)})
    whole = _distinct_terms(spans).withColumns({"near": F.lit(0), "whole": F.lit(1)})
    held = told.unionByName(whole).groupBy("term").agg(F.sum("near").alias("near"), F.sum("whole").alias("whole"))
    held = _settle(held.filter((F.col("near") >= limits.support) & (F.length("term") >= limits.shortest)), "entity-terms")
    # An inner join with distinct terms: Spark would move a semi join below the count.
    counted = seen.join(held, "term").join(extra, "term", "left")
    elsewhere = F.col("n") - F.coalesce("x", F.lit(0)) - F.col("whole")
    counted = counted.select("term", "near", (elsewhere + F.col("near")).alias("docs_term"))
    return _settle(counted.filter(F.col("near") / F.col("docs_term") >= limits.certainty).drop("near"), "candidates")


def _surroundings(spans: DataFrame, mentions: DataFrame, pairs: DataFrame, limits: Thresholds) -> DataFrame:
    """``term, entity, surroundings`` of the ``pairs``: distinct surroundings of the term or of the entity, whichever are more."""
    width = limits.reach_words
    words = spans.select("doc", _words(F.col("outside")).alias("words"))
    place = lambda w, i: F.struct(_term(w).alias("term"), F.xxhash64(F.slice("words", F.greatest(F.lit(1), i + 1 - width), width + 1 + F.least(i, F.lit(width)))).alias("around"))
    places = words.select("doc", F.explode(F.transform("words", place)).alias("x")).select("doc", "x.term", "x.around")
    places = _settle(places.join(pairs.select("term").distinct(), "term"), "term-surroundings")
    both = places.select("doc", "term").distinct().join(pairs.select("term", "entity"), "term")
    both = both.join(mentions.select("doc", "entity").distinct(), ["doc", "entity"])
    both = _settle(both.select("doc", "term", "entity"), "term-entity-documents")
    sides = {}
    for side, known in (("of_term", places.join(both, ["doc", "term"])), ("of_entity", mentions.join(both, ["doc", "entity"]))):
        once = known.groupBy("term", "entity", "around").agg(F.count(F.lit(1)).alias("n"))
        sides[side] = once.groupBy("term", "entity").agg(F.count(F.lit(1)).alias(side))
    joined = sides["of_term"].join(sides["of_entity"], ["term", "entity"])
    return joined.select("term", "entity", F.greatest("of_term", "of_entity").alias("surroundings"))


def revealing_terms(docs: DataFrame, spans: DataFrame, limits: Thresholds = STANDARD) -> tuple[DataFrame, DataFrame]:
    """The terms at risk (``term, entity, certainty, bits``), and the documents (``doc_id, text_key, term``) that hold one.

    ``spans`` has the documents with spans, each once, with a number ``doc`` and their text ``outside`` the spans;
    ``docs`` has all of them (doc_id, text, text_key).
    """
    mentions = _settle(_mentions(spans, limits), "mentions")
    twice = _settle(docs.groupBy("doc_id", "text_key").agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0"), "repeated-rows")
    repeated = twice.toDF("d", "t", "extra")
    repeated = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["d"]) & (docs["text_key"] == repeated["t"])).drop("d", "t").dropDuplicates(["doc_id", "text_key"])
    candidates = _candidates(docs, repeated, spans, limits)
    entities = mentions.select("doc", "entity").distinct()
    terms = _distinct_terms(spans, "doc", text="outside").join(candidates.select("term"), "term")
    both = terms.join(entities, "doc").groupBy("term", "entity").agg(F.count(F.lit(1)).alias("docs_both"))
    entity = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("docs_entity"))
    every = docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(twice.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("x"))).select((F.col("n") - F.col("x")).alias("docs"))  # one row
    scored = both.filter(F.col("docs_both") >= limits.support).join(candidates, "term").join(entity, "entity").crossJoin(F.broadcast(every))
    scored = scored.withColumn("certainty", F.col("docs_both") / F.col("docs_term"))
    own = F.log2(F.col("docs") / F.col("docs_entity"))
    scored = scored.withColumn("bits", F.log2("certainty") + own)
    scored = scored.filter((F.col("certainty") >= limits.certainty) & (F.col("bits") > 0) & (F.col("bits") >= limits.share * own))
    scored = _settle(scored.select("term", "entity", "certainty", "bits"), "scored-terms")
    risks = scored.join(_surroundings(spans, mentions, scored, limits), ["term", "entity"])
    enough = (F.col("surroundings") >= limits.support) & (F.col("surroundings") * F.col("bits") >= limits.evidence)
    risks = _settle(risks.filter(enough).select("term", "entity", "certainty", "bits"), "revealing-terms")
    hits = _distinct_terms(docs, "doc_id", "text_key").join(risks.select("term").distinct(), "term", "left_semi").distinct()
    return risks, _settle(hits, "term-documents")


def _term_places(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``doc_id, text_key, term`` spans of the terms that ``keys`` names for each document."""
    wanted = _settle(keys.groupBy("doc_id", "text_key").agg(F.collect_set("term").alias("wanted")), "wanted-terms")
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["text_key"] == wanted["text_key"])
    held = docs.join(wanted, same).select(docs["doc_id"], docs["text_key"], "text", "wanted").dropDuplicates(["doc_id", "text_key"])
    held = held.withColumn("words", _words(F.col("text"))).withColumn("gaps", F.split("text", f"[^{SPACE}]+", -1))
    each = held.select("doc_id", "text_key", "wanted", F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("words")).alias("g"), F.col("words").alias("w"))).alias("k", "x"))
    upto = Window.partitionBy("doc_id", "text_key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.length("x.g") + F.length("x.w")).over(upto).cast("int"))
    each = each.filter(F.array_contains("wanted", _term(F.col("x.w"))))
    lead = F.length(F.regexp_extract("x.w", r"^[^\p{L}\p{N}]*+", 0))
    tail = F.length(F.regexp_extract("x.w", r"[^\p{L}\p{N}]*+$", 0))
    span = F.struct((F.col("end") - F.length("x.w") + lead).alias("s"), (F.col("end") - tail).alias("e"))
    return each.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(span)).alias("term"))


def find(df: DataFrame, limits: Thresholds = STANDARD, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Span arrays of every kind, ``term`` included, for every row."""
    spans = base_spans(df, id_col, text_col)
    docs = _texts(df, id_col, text_col)
    some = sum((F.size(kind) for kind in KINDS), F.lit(0)) > 0
    held = spans.filter(some).dropDuplicates(["doc_id", "text_key"])
    held = held.withColumns({"doc": F.monotonically_increasing_id(), "outside": _outside()})
    _, hits = revealing_terms(docs, _settle(held, "entity-documents"), limits)
    places = _settle(_term_places(docs, hits), "term-spans")
    places = places.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "term")
    out = spans.join(places, spans["doc_id"].eqNullSafe(places["d"]) & (spans["text_key"] == places["t"]), "left")
    empty = F.array().cast("array<struct<s:int,e:int>>")
    columns = [F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(kind) for kind in KINDS]
    return out.select("doc_id", *(["text"] if with_text else []), *columns, F.coalesce("term", empty).alias("term"))


def sanitise(df: DataFrame, limits: Thresholds = STANDARD) -> DataFrame:
    """``doc_id`` and its text with every span generalised to the name of its kind; a span that begins inside an earlier one is dropped."""
    found = find(df, limits, with_text=True)
    every = F.sort_array(_mapped((*KINDS, "term"), lambda kind, x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(NAMES[kind]).alias("n"))))
    # The end reached so far, below zero where the span itself is dropped.
    reach = lambda at, x: F.when(x["s"] >= F.abs(at), -x["e"]).otherwise(-F.abs(at))
    kept = lambda spans: F.filter(F.zip_with(spans, _scan(spans, F.lit(0), reach, "int"), lambda x, at: F.when(at >= 0, x)), lambda x: x.isNotNull())
    turned = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["n"].alias("n")))
    names = lambda spans: F.concat(F.transform(spans, lambda x: x["n"]), F.array(F.lit("")))
    shown = _let(every, lambda e: _let(turned(kept(e)), lambda spans: F.array_join(F.zip_with(_gaps(spans, _pieces(F.col("text")), F.length("text")), names(spans), lambda g, n: F.concat(g, n)), "")))
    return found.select("doc_id", shown.alias("text"))


def digest(df: DataFrame, limits: Thresholds = STANDARD) -> DataFrame:
    """Counts and joined spans of every document."""
    found = find(df, limits)
    shown = lambda kind, x: F.concat_ws(":", F.lit(kind), x["s"], x["e"])
    base = F.array_join(_mapped(KINDS, shown), ",")
    every = F.array_join(_mapped((*KINDS, "term"), shown), ",")
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("term").cast("long").alias("n_term"))
