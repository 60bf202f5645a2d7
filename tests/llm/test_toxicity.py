import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import clashing, prose, rows_of

from loglattice.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def corpus(spark):
    """Two kinds of prose; toxic texts hold one of a few expressions somewhere."""
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(900):
        text = prose(rng, rng.randrange(20, 200)).split()
        bad = k % 4 == 0
        if bad:
            at = rng.randrange(len(text))
            text[at:at] = rng.choice(["you vile grub", "utter filth here", "rotten vile filth"]).split()
        rows.append((k, " ".join(text), "en", "a", 1))
        if k % 10 != 7:
            labels.append((k, 1, int(bad)))
    rows += [(2000, None, "en", "a", 0), (2001, "", "en", "a", 0), (None, "no id", "en", "a", 0), (1, "a second text of one id", "en", "a", 0)]
    labels += [(3, 1, None), (None, 1, 1), (5, None, 0), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs, spark.createDataFrame(labels, LABELS), rows


def test_held_out_documents(corpus):
    docs, labels, rows = corpus
    got = rows_of(toxicity.score(clashing(docs), labels))
    assert len(got) == len(rows)
    assert all(r[1] == (fold(r[0]) == 0) and 0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in got)
    held = [(r[0] % 4 == 0, r[2], r[3]) for r in got if r[1] and r[0] is not None and r[0] < 900]
    assert np.mean([bad == bool(p) for bad, _, p in held]) >= 0.9
    toxic, ordinary = [s for bad, s, _ in held if bad], [s for bad, s, _ in held if not bad]
    assert np.mean([a > b for a in toxic for b in ordinary]) >= 0.95


def test_labels_of_held_out_rows_are_not_read(spark, corpus):
    docs, labels, _ = corpus
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(rows_of(toxicity.score(docs, labels)), key=key) == sorted(rows_of(toxicity.score(docs, turned)), key=key)


def test_one_class_or_nothing(spark, corpus, nothing):
    docs, labels, _ = corpus
    assert {r[2] for r in rows_of(toxicity.score(docs, labels.filter("toxic = 1")))} == {1.0}
    assert {r[2] for r in rows_of(toxicity.score(docs, labels.limit(0)))} == {0.0}
    assert toxicity.score(nothing, labels).count() == 0


TAUGHT = [("a b c a b", 1), ("a c b grub", 1), ("a b d d", 0), ("c d a", 0), ("a b a b d a", 0)]


def plain_model(order, discount=toxicity.DISCOUNT, history=1):
    """p(word | word before) of a class, written down with dictionaries."""
    pairs = {c: Counter() for c in (0, 1)}
    for text, c in TAUGHT:
        line = ["<s>", *text.split()]
        pairs[c].update(zip(line, line[1:], strict=False))
    vocabulary = {w for c in pairs for _, w in pairs[c]}

    def level(counts, w):
        total = sum(counts.values())
        rest = sum(min(n, discount) for n in counts.values())
        return (counts[w] - min(counts[w], discount)) / total + rest / total / (len(vocabulary) + 1)

    def p(c, w, h):
        words, after = Counter(), Counter()
        for (a, b), n in pairs[c].items():
            words[b] += n if order == 1 else 1
            after[b] += n if a == h else 0
        low = level(words, w)
        seen = [sum(n for (a, _), n in pairs[k].items() if a == h) for k in (0, 1)]
        if order == 1 or h == "<s>" or min(seen) < history:
            return low
        rest = sum(min(n, discount) for n in after.values())
        return (after[w] - min(after[w], discount)) / seen[c] + rest / seen[c] * low

    return p, vocabulary


@pytest.mark.parametrize(("order", "history"), [(1, 1), (2, 1), (2, 3)])
def test_probabilities_match_a_plain_model(spark, order, history):
    counts = toxicity._counts(spark.createDataFrame(TAUGHT, "text string, toxic int"))
    model = toxicity._model(counts, history=history)
    p, vocabulary = plain_model(order, history=history)
    for text in ("a b grub unheard b unheard unheard c d a", "grub", "d d a c"):
        line = text.split()
        words, before, _ = toxicity._tokens(toxicity.pa.array([text]))
        got = model.probabilities(words, before, order)
        want = [[p(c, w, h) for h, w in zip(["<s>", *line], line, strict=False)] for c in (1, 0)]
        assert got == pytest.approx(np.array(want))
    for h in vocabulary | {"<s>"}:  # over all words and one unknown one
        assert sum(p(1, w, h) for w in vocabulary | {"?"}) == pytest.approx(1)
    evidence = model.evidence(toxicity.pa.array(["a b grub c", None, ""]), (order,), (1, 2, None))
    steps = [np.log(p(1, w, h) / p(0, w, h)) for h, w in zip(["<s>", "a", "b", "grub"], "a b grub c".split(), strict=True)]
    assert evidence[0] == pytest.approx([max(steps), max(np.add(steps[1:], steps[:-1])) / 2, np.mean(steps)])
    assert not evidence[1:].any()


def test_rare_expressions_count_in_production(spark):
    """A word seen once, in a toxic document, is evidence; an unknown word is almost none."""
    rng = random.Random(8)
    rows = [(prose(rng, 40, 60) + (" grub" if k == 1 else ""), k % 2) for k in range(300)]
    model = toxicity._model(toxicity._counts(spark.createDataFrame(rows, "text string, toxic int")))
    words, before, _ = toxicity._tokens(toxicity.pa.array(["grub unheard"]))
    for order in (1, 2):
        toxic, ordinary = model.probabilities(words, before, order)
        assert np.log(toxic[0] / ordinary[0]) > 0.2 > abs(np.log(toxic[1] / ordinary[1]))


def test_very_long_text(spark, corpus):
    """A toxic expression inside a text of 300,000 words is found, and the same text without it is left alone."""
    docs, labels, _ = corpus
    rng = random.Random(6)
    words = prose(rng, 300_000).split()
    rows = [(5000, " ".join(words), "en", "a", 1), (5001, " ".join([*words[:170_000], "you", "vile", "grub", *words[170_000:]]), "en", "a", 1)]
    got = {r[0]: r[3] for r in rows_of(toxicity.score(docs.unionByName(spark.createDataFrame(rows, docs.schema)), labels)) if r[0] in (5000, 5001)}
    assert got == {5000: 0, 5001: 1}
