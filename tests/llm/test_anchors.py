import hashlib
import random
from collections import Counter

import pytest
from cases import clashing, prose, rows_of, words

from loglattice.llm import anchors


def plain(rows, window):
    """Removes every word covered by a window that starts in two places."""
    texts = [words(r[1]) for r in rows]
    seen = Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for row, w in zip(rows, texts, strict=True):
        gone = {i for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for i in range(k, k + window)}
        out.append((row[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def passages(seed=4):
    """Texts that share passages at all offsets, some just too short, some twice in one text."""
    rng = random.Random(seed)
    shared = [prose(rng, n, 50_000).split() for n in (34, 35, 36, 52, 53, 70, 200)]
    rows = []
    for k in range(60):
        w = prose(rng, rng.randrange(0, 90), 50_000).split()
        for _ in range(k % 4):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        rows.append((100 + k, " ".join(w) if k % 5 else "\n ".join(w), None, None, 0))
    rows += [(300 + k, prose(random.Random(9), 150), None, None, 0) for k in range(30)]
    rows += [(400, " ".join(["round"] * 90), None, None, 0), (401, "a b c " * 40, None, None, 0)]
    return rows


@pytest.mark.parametrize(("window", "block_bytes"), [(35, anchors.BLOCK_BYTES), (35, 900), (7, 2000), (8, 500)])
def test_matches_plain_version(spark, awkward, awkward_rows, window, block_bytes):
    more = passages()
    df = awkward.unionByName(spark.createDataFrame(more, awkward.schema).coalesce(2))
    want = plain(awkward_rows + more, window)
    found = anchors.remove_repeats(clashing(df), window, block_bytes=block_bytes).cache()
    assert sorted(rows_of(found.select("doc_id", "n_words", "n_removed", "text")), key=repr) == want
    for row in found.collect():
        assert sum(s["end"] - s["start"] for s in row["spans"]) == row["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(row["spans"], row["spans"][1:], strict=False))
    digests = anchors.remove_repeats(df, window, digest=True, block_bytes=block_bytes).select("doc_id", "text")
    assert Counter(rows_of(digests)) == Counter((r[0], hashlib.sha256(r[3].encode()).hexdigest()) for r in want)
    found.unpersist()


def test_short_keys_cost_lookups_only(spark, awkward, awkward_rows, monkeypatch):
    monkeypatch.setattr(anchors, "MORE_BITS", -12)  # chance hits everywhere
    more = passages(6)
    df = awkward.unionByName(spark.createDataFrame(more, awkward.schema))
    found = anchors.remove_repeats(df).select("doc_id", "n_words", "n_removed", "text")
    assert sorted(rows_of(found), key=repr) == plain(awkward_rows + more, 35)


def test_nothing_and_blank(spark, nothing):
    assert anchors.remove_repeats(nothing).count() == 0
    df = spark.createDataFrame([(1, None), (2, " \n"), (None, "a b")], "doc_id long, text string")
    assert sorted(rows_of(anchors.remove_repeats(df).select("n_words", "n_removed", "text"))) == [(0, 0, ""), (0, 0, ""), (2, 0, "a b")]
