import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import clashing, prose, rows_of, words

from loglattice.llm import periodic


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[k] == w[k + p] for k in range(len(w) - p)))


def plain_runs(w):
    """Every run, by trying all periods at all places."""
    n, found = len(w), set()
    for p in range(1, n // 4 + 1):
        k = 0
        while k + p < n:
            end = k
            while end + p < n and w[end] == w[end + p]:
                end += 1
            length = end - k + p
            if end > k and length >= max(6, 4 * p) and smallest_period(w[k : k + length]) == p:
                found.add((k, length, p))
            k = max(end, k + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, planted=True):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown, left = "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for k, x in enumerate(w) if k not in dropped)
    return doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha(shown), sha(left)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    texts = [rng.integers(0, letters, n) for n in (0, 1, 5, 6, 7, 40, 120, 300)]
    texts += [np.tile(rng.integers(0, 50, p), 9)[: 6 * p + p // 2] for p in (1, 2, 5, 12)] + [np.tile([0, 0, 0, 0, 0, 0, 1], 8)]
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    start, length, period = periodic.find_runs(np.concatenate(texts), bounds)
    for k, text in enumerate(texts):
        mine = [(int(s - bounds[k]), int(n), int(p)) for s, n, p in zip(start, length, period, strict=True) if bounds[k] <= s < bounds[k + 1]]
        assert mine == plain_runs(list(text)), k


def test_few_points_at_a_time_change_nothing(monkeypatch):
    text = np.tile(np.random.default_rng(1).integers(0, 3, 11), 30)
    whole = periodic.find_runs(text, np.array([0, 100, len(text)]))
    monkeypatch.setattr(periodic, "POINTS", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, periodic.find_runs(text, np.array([0, 100, len(text)])), strict=True))


def test_suffixes_give_common_prefixes():
    symbols = np.random.default_rng(3).integers(0, 2, 200)
    made = periodic.Suffixes(symbols)
    i, j = np.divmod(np.arange(200 * 200), 200)
    i, j = i[i != j], j[i != j]

    def shared(a, b):
        k = 0
        while max(a, b) + k < 200 and symbols[a + k] == symbols[b + k]:
            k += 1
        return k

    assert list(made.shared(i, j)) == [shared(a, b) for a, b in zip(i, j, strict=True)]


def test_query_matches_plain_version(spark, awkward, awkward_rows):
    rng = random.Random(2)
    more = [(1000 + k, " ".join(rng.choice(["la", "di", "da", "Da"]) for _ in range(k % 70)), None, None, 0) for k in range(150)]
    more += [(2000 + k, prose(rng, 40) + " " + "\t".join(["ja so é"] * (k + 2)) + prose(rng, 9), None, None, 0) for k in range(6)]
    df = awkward.unionByName(spark.createDataFrame(more, awkward.schema))
    got = rows_of(periodic.digest(periodic.collapse_runs(clashing(df), periodic.planted_tail)))
    assert sorted(got, key=repr) == sorted((plain(r[0], r[1]) for r in awkward_rows + more), key=repr)
    assert sum(r[1] > 0 for r in got) > 15
    untouched = periodic.digest(periodic.collapse_runs(df))
    assert sorted(rows_of(untouched), key=repr) == sorted((plain(r[0], r[1], False) for r in awkward_rows + more), key=repr)


def test_long_text_and_nothing(spark, nothing):
    text = "x " * 60_000 + "y"
    row = periodic.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 60_000, 1)] and row["text"] == "x y" and row["n_words"] == 60_001
    assert periodic.digest(periodic.collapse_runs(nothing)).count() == 0
