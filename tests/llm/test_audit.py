import itertools
import re

from cases import clashing, rows_of, words

from loglattice.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """Every document walked through every order."""
    known = {}
    for doc_id, quality, toxic in (x for x in labels if x[0] is not None):
        good, bad = known.get(doc_id, (0, 0))
        known[doc_id] = (max(good, int(quality == 1)), max(bad, int(toxic == 1)))
    facts = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        w = words(text)
        copy = doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows)
        tests = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
        facts.append((source or "", {c for c, x in zip("ABCDE", tests, strict=True) if x}, *known.get(doc_id, (0, 0))))
    out = []
    for part in {f[0] for f in facts}:
        mine, total, found = [f[1:] for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[0]]
                failing = [f for f in mine if x in f[0]]
                left = [f for f in left if x not in f[0]]
                total[x] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(f[0] == {x} for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone), x))
        out += [(*f[:-1], total[f[-1]]) for f in found]
    return sorted(out)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_matches_plain_version(spark, awkward, awkward_rows):
    labels = [(k, k % 2, k % 3 == 0) for k in range(1, 50)] + [(6, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, 1)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    got = audit.audit(clashing(awkward), labels_of(spark, labels)).select(COLUMNS)
    assert sorted(rows_of(got)) == plain(awkward_rows, labels)


def test_equal_rows_count_each_and_are_no_copies_of_one_another(spark):
    text = "word " * 60
    docs = spark.createDataFrame([(5, text, "s"), (5, text, "s"), (9, text, "s"), (3, text + "x", "s")], "doc_id long, text string, source string")
    first = audit.audit(docs, labels_of(spark, [])).filter("filter_order = 'EABCD' and step <= 3").orderBy("step").select("kept", "removed", "redundant", "unique_fails").collect()
    assert [tuple(r) for r in first] == [(3, 1, 0, 0), (3, 0, 0, 0), (0, 3, 1, 3)]


def test_no_documents_give_no_rows(spark, nothing):
    assert audit.audit(nothing, labels_of(spark, [])).count() == 0


def test_texts_cross_one_shuffle(spark, awkward, capsys):
    audit.audit(awkward, labels_of(spark, [])).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("REPARTITION_BY_COL") == 1 and not any(node in plan for node in ("EvalPython", "InArrow", "InPandas"))
