import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from cases import SCHEMA, clashing, prose, rows_of, words
from plain import PATTERNS, personal
from pyspark.sql import functions as F

from loglattice.llm import pii

PIECES = ["a@b.c", "x.y+z%q@m-n.co.uk", "@", ".", "-", " ", "..", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "12", "3", "+1 (555) 123-4567", "+", "é", "東", "\n", "_", "5500005555555559", "(", ")", "\x01", "w"]


def rows_for(texts):
    return [(k, text, "en", "a", 1) for k, text in enumerate(texts)]


def test_base_spans_match_the_patterns(spark, awkward_rows):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    texts += [r[1] for r in awkward_rows] + ["1" * 5000, "a@" * 3000, "a." * 4000 + "@b", "x@" + "y." * 3000 + "z", "1 " * 4000]
    got = {r["doc_id"]: r for r in pii.digest(clashing(spark.createDataFrame(rows_for(texts), SCHEMA).repartition(4))).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = personal(text)
        joined = ",".join(f"{kind}:{a}:{b}" for kind, a, b in want)
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [sum(x[0] == kind for x in want) for kind in PATTERNS], text
        assert got[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert got[k]["spans"].split(",")[: len(want)] == (joined.split(",") if joined else [])


@pytest.fixture(scope="module")
def leaking(spark):
    """A rare name stands beside one address in different surroundings; common words do too."""
    rng = random.Random(8)
    texts = [f"{prose(rng, 30)} write Zorblax at zor@corp.example {prose(rng, 20)}" for _ in range(12)]
    texts += [f"{prose(rng, 30)} write w1 at ann{k}@corp.example {prose(rng, 20)}" for k in range(12)]
    texts += [f"{prose(rng, 20)} (zorblax) said {prose(rng, 20)}"] + [prose(rng, 50) for _ in range(300)]
    texts += [f"{prose(random.Random(1), 9)} copied Quux q@q.example {prose(random.Random(2), 9)}"] * 40
    return spark.createDataFrame(rows_for(texts), SCHEMA).repartition(3)


def test_terms_that_disclose_are_found(leaking):
    found = {r["doc_id"]: r for r in pii.digest(leaking).collect()}
    assert all(found[k]["n_term"] == 1 for k in range(12)) and found[24]["n_term"] == 1
    assert sum(r["n_term"] for r in found.values()) == 13  # common words, and words beside copies of one passage, disclose nothing
    text = {r["doc_id"]: r["text"] for r in leaking.collect()}[24]
    kind, start, end = found[24]["spans"].split(":")
    assert (kind, text[int(start) : int(end)]) == ("term", "zorblax")


def test_sanitised_texts_hold_none_of_it(leaking, nothing):
    for r in pii.sanitise(leaking).collect():
        assert not personal(r["text"]) and "orblax" not in r["text"]
        if r["doc_id"] < 12:
            assert "[TERM] at [EMAIL]" in r["text"]
    assert pii.sanitise(nothing).count() == 0 and pii.digest(nothing).count() == 0


def test_rows_stay_one_to_one(awkward, awkward_rows):
    assert len(rows_of(pii.digest(awkward))) == len(awkward_rows)


def test_terms_elsewhere_in_the_document_are_found(spark):
    """A name in the title reveals an address lines below; so does one whose entity an eighth of the documents hold."""
    rng = random.Random(9)
    texts = [f"Zorblax\n\n{prose(rng, 60)}\n\nwrite to zor@corp.example" for _ in range(6)]
    texts += [f"dear Quuxly,\n{prose(rng, 60)}\nfrom 10.1.2.3 {prose(rng, 30)}" for _ in range(60)]
    texts += [prose(rng, 80) for _ in range(400)]
    found = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows_for(texts), SCHEMA).repartition(3)).collect()}
    named = {k: sorted(texts[k][int(s) : int(e)] for kind, s, e in (x.split(":") for x in r["spans"].split(",") if x) if kind == "term") for k, r in found.items()}
    assert all("Zorblax" in named[k] for k in range(6))
    assert all("Quuxly" in named[k] for k in range(6, 66))
    assert not any(named[k] for k in range(66, len(texts)))


def bare(word):
    return re.sub(r"^[^\w]+|[^\w]+$", "", word.replace("_", "-")).lower()


def plain_terms(rows, limits=pii.STANDARD):
    """The terms at risk, from whole documents, by plain counting."""
    docs, mentions, places, near, everywhere = list(dict.fromkeys((r[0], r[1] or "") for r in rows)), [], [], Counter(), Counter()
    for d, (_, text) in enumerate(docs):
        spans = sorted((a, b, kind) for kind, a, b in personal(text))
        if not spans:
            everywhere.update({bare(w) for w in words(text)})
            continue
        gaps, at = [], 0
        for a, b, kind in spans:
            around = words(text[max(0, a - limits.reach_chars) : a])[::-1][: limits.reach_words] + words(text[b : b + limits.reach_chars])[: limits.reach_words]
            mentions.append((d, f"{kind}:{text[a:b].lower()}", tuple(around)))
            gaps.append(text[at:a] if a > at else "")
            at = max(at, b)
        w = words(" ".join([*gaps, text[at:]]))
        places += [(d, bare(x), tuple(w[max(0, i - limits.reach_words) : i + limits.reach_words + 1])) for i, x in enumerate(w)]
        near.update({bare(x) for x in w})
    of_doc, of_term = {}, {}
    for d, entity, _ in mentions:
        of_doc.setdefault(d, set()).add(entity)
    for d, term, _ in places:
        of_term.setdefault(term, set()).add(d)
    held = Counter(e for found in of_doc.values() for e in found)
    risks = set()
    for term, among in of_term.items():
        total = near[term] + everywhere[term]
        if near[term] < limits.support or len(term) < limits.shortest or near[term] / total < limits.certainty:
            continue
        for entity, both in Counter(e for d in among for e in of_doc[d]).items():
            own = math.log2(len(docs) / held[entity])
            bits = math.log2(both / total) + own
            if both < limits.support or both / total < limits.certainty or bits <= 0 or bits < limits.share * own:
                continue
            shared = {d for d in among if entity in of_doc[d]}
            around = max(len({a for d, t, a in places if t == term and d in shared}), len({a for d, e, a in mentions if e == entity and d in shared}))
            if around >= limits.support and around * bits >= limits.evidence:
                risks.add(term)
    return risks


def term_spans(text, risks):
    out = []
    for m in re.finditer("[^\\x20\\x09-\\x0D]+", text or ""):
        if bare(m[0]) in risks:
            lead = len(m[0]) - len(re.sub(r"^[\W_]+", "", m[0]))
            out.append((m.start() + lead, m.start() + len(re.sub(r"[\W_]+$", "", m[0]))))
    return sorted(out)


def test_terms_match_plain_statistics(spark):
    rng = random.Random(12)
    names = [f"Name{k}" for k in range(12)]
    texts = []
    for k in range(500):
        parts = [prose(rng, rng.randrange(5, 40), 300)]
        for _ in range(rng.randrange(3)):
            n = rng.randrange(12)
            shown = f"({names[n]})," if rng.random() < 0.8 else names[n].upper()
            loose = [f"{shown} is at 10.0.0.{n}", shown, f"n{n}@x.example", "+1 555 123-4567", prose(rng, 4, 300)]
            parts.append(f"{shown} mail n{n}@x.example" if rng.random() < (0.97 if n < 6 else 0.3) else rng.choice(loose))
        rng.shuffle(parts)
        texts.append(rng.choice([" ", "\n\n"]).join(parts))
    texts += texts[:40] + [f"{prose(random.Random(1), 9)} copied Quux q@q.example {prose(random.Random(2), 9)}"] * 40 + [f"{names[0]} n0@x.example"] * 9
    rows = rows_for(texts) + rows_for(texts)[::7]
    risks = plain_terms(rows)
    assert len(risks) > 2 and not any(f"name{k}" in risks for k in range(6, 12))
    for r in pii.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got = sorted((int(a), int(b)) for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x) if kind == "term")
        assert got == term_spans(texts[r["doc_id"]], risks)


def test_many_matches_take_time_in_proportion(spark):
    def seconds(n):
        text = "".join(f"user{k}@host.example 10.1.{k % 250}.7 x " for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        best = []
        for _ in range(2):
            began = time.perf_counter()
            row = pii.base_spans(df).select(F.size("email"), F.size("ip"), F.element_at("ip", -1)["e"]).first()
            best.append(time.perf_counter() - began)
            assert tuple(row) == (n, n, len(text) - 3)
        return min(best)

    seconds(100)
    few, many = seconds(10_000), seconds(20_000)
    assert many < 10 and many <= 2.5 * few + 1
    text = "".join(f"user{k}@host.example 10.1.{k % 250}.7 x " for k in range(3000))
    assert pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"] == "[EMAIL] [IP] x " * 3000
