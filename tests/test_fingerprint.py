"""Fingerprints: any grouping, and what tells an append from a change."""

import random

import pytest

from loglattice.operators import fingerprint as fp

SCHEMA = "store string, pos long, kind string, body string"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), k * 3, rng.choice(["x", "y", None, ""]), "z" * rng.randrange(9)) for k in range(n)]


def made(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return fp.fingerprint(df, ["store"], "pos", ["pos", "kind"], ["body"], **more)


def plain(data):
    from hashlib import md5

    out = {}
    for store in {r[0] for r in data}:
        h = [0, 0]
        for _, pos, kind, body in sorted((r for r in data if r[0] == store), key=lambda r: r[1]):
            shown = "\x1f".join([f"={pos}", "-" if kind is None else f"={kind}", "-" if body is None else str(len(body))])
            digest = md5(shown.encode()).hexdigest()
            h = [(h[k] * fp.BASES[k] + int(digest[8 * k : 8 * k + 7], 16)) % fp.PRIMES[k] for k in (0, 1)]
        out[store] = f"{h[0]}-{h[1]}"
    return out


@pytest.mark.parametrize(("bucket", "fan"), [(1 << 12, 256), (10, 2), (1, 3)])
def test_any_grouping_gives_the_same(spark, bucket, fan):
    data = rows(150)
    got = made(spark, data, bucket=bucket, fan=fan).collect()
    assert {r["store"]: r["fingerprint"] for r in got} == plain(data)
    assert {r["store"]: (r["n"], r["last"]) for r in got} == {s: (sum(r[0] == s for r in data), max(r[1] for r in data if r[0] == s)) for s in ("a", "b", None)}
    assert made(spark, []).count() == 0


def test_changes(spark):
    base = [(s, k, f"r{k}", "body") for s in ("same", "more", "swapped", "edited", "longer", "lost", "gone", None) for k in range(20)]
    old = made(spark, base)
    new = [r for r in base if r[0] != "gone" and not (r[0] == "lost" and r[1] == 7)]
    new = [("swapped", {3: 4, 4: 3}.get(r[1], r[1]), *r[2:]) if r[0] == "swapped" else ("edited", r[1], "other", r[3]) if r[0] == "edited" and r[1] == 5 else (*r[:3], "longer") if r[0] == "longer" and r[1] == 0 else r for r in new]
    new += [("more", 20, "r20", None), ("new", 0, "r0", "b"), (None, 21, "r", "b")]
    got = fp.changes(old, spark.createDataFrame(new, SCHEMA), ["store"], "pos", ["pos", "kind"], ["body"])
    want = {"same": "same", "more": "appended", "swapped": "changed", "edited": "changed", "longer": "changed", "lost": "changed", "gone": "gone", "new": "new", None: "appended"}
    assert {r["store"]: r["verdict"] for r in got.collect()} == want
