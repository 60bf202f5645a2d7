import math
import random
import zlib
from collections import Counter

import pytest
from cases import SCHEMA, clashing, lowered, prose, rows_of, words
from pyspark.sql import functions as F

from loglattice.llm import lm


def fold(doc_id, folds=7):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def brute(rows, order=lm.ORDER, mu=lm.MU):
    """The model written down plainly: counts of all n-grams in dictionaries, probabilities by recursion."""
    sequences = [(r[0], [*words(lowered(r[1] or "")), None]) for r in rows]
    padded = lambda tokens: ["<s>"] * (order - 1) + [(w,) for w in tokens]
    grams, histories = Counter(), Counter()
    for doc_id, tokens in sequences:
        if fold(doc_id) != 2:
            line = padded(tokens)
            for at in range(order - 1, len(line)):
                for k in range(order):
                    grams[tuple(line[at - k : at + 1])] += 1
                    histories[tuple(line[at - k : at])] += 1
    total = histories[()]
    kinds = sum(len(g) == 1 for g in grams)

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (total + kinds + 1)
        seen, weight = histories[gram[:-1]], mu[len(gram) - 2]
        return (grams[gram] + weight * p(gram[1:])) / (seen + weight) if seen else p(gram[1:])

    out = []
    for doc_id, tokens in sequences:
        line = padded(tokens)
        ends = range(order - 1, len(line))
        base = sum(math.log10(p((line[at],))) for at in ends)
        full = sum(math.log10(p(tuple(line[at - order + 1 : at + 1]))) for at in ends)
        out.append((doc_id, fold(doc_id) == 2, len(tokens), sum(grams[(w,),] > 0 for w in tokens), total, base, full))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[2], row[5])


@pytest.mark.parametrize(("order", "block_bytes"), [(3, lm.BLOCK_BYTES), (3, 600), (1, 600), (5, 900)])
def test_scores_match_a_plain_model(awkward, awkward_rows, order, block_bytes):
    got = sorted(rows_of(lm.score(clashing(awkward), ~lm.held_out(F.col("doc_id")), order, block_bytes=block_bytes)), key=key)
    want = sorted(brute(awkward_rows, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for mine, theirs in zip(got, want, strict=True):
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9)


def test_arcs_and_failures_sum_to_one():
    """From a state of two words, over the vocabulary and one unknown word."""
    taught = "a b c a b d a b c".split()
    block = lm.Block(lm.pa.array(["a b c", "a b d", "a b a", "a b b", "a b x"]))
    plain = lambda gram: sum(tuple(taught[k : k + len(gram)]) == gram for k in range(len(taught)))
    texts = [["a", "b", w, "</s>"] for w in "cdabx"]
    counts = [lm.np.array([plain(tuple(t[k - n : k + 1])) if k >= n else 0 for t in texts for k in range(4)]) for n in range(3)]
    machine = lm.Automaton(block, counts, 0, len(taught), 4)
    third = lm.np.arange(5) * 4 + 2
    weight = lm.np.where(machine.arcs[2] > 0, machine.arcs[2], machine.fails[2] * lm.np.where(machine.arcs[1] > 0, machine.arcs[1], machine.fails[1] * machine.root))[third]
    assert counts[2][third].tolist() == [2, 1, 0, 0, 0] and (machine.fails[2][third] < 1).all()
    assert weight.sum() == pytest.approx(1)


def test_higher_orders_tell_repeated_passages(spark):
    """A held-out text that training holds too scores higher with three words of context than with two."""
    rng = random.Random(4)
    rows = [(k, prose(rng, 60, 40), "en", "a", 1) for k in range(400)]
    copies = [(1000 + k, rows[k][1], "en", "a", 1) for k in range(40) if fold(rows[k][0]) != 2 and fold(1000 + k) == 2]
    df = spark.createDataFrame(rows + copies, SCHEMA)
    two, three = ({r[0]: r[6] for r in rows_of(lm.score(df, ~lm.held_out(F.col("doc_id")), order))} for order in (2, 3))
    assert copies and all(three[c[0]] > two[c[0]] + 10 for c in copies)


def test_blocks_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(0, 40)) if rng.random() < 0.8 else "" for _ in range(200)]
    rows = lm.pa.table({"doc_id": list(range(200)), "text": texts})
    seen = [[(number, block.column("doc_id").to_pylist()) for number, block in lm.blocks(iter(rows.to_batches(max_chunksize=size)), 500)] for size in (200, 7, 1)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 5 and len({number for number, _ in seen[0]}) == len(seen[0])


def test_no_training_rows_and_no_rows(spark, awkward, nothing):
    got = rows_of(lm.score(awkward, F.lit(False)))
    assert len(got) == awkward.count() and all(r[3] == r[4] == 0 and r[5] == r[6] == 0 for r in got)
    assert lm.score(nothing, ~lm.held_out(F.col("doc_id"))).count() == 0
