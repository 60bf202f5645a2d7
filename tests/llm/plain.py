"""Plain, slow versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from cases import lowered, words

SPACE = " \t\n\x0b\f\r"


# --- quality rules -----------------------------------------------------------


def quality(text):
    """Measurements, failure bits, base_failed and kept."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = set()
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            inside |= set(range(k, k + 8))
    n, chars = len(w), sum(map(len, w))
    symbols, upper = sum(c in "#*$%&|<>" for c in text), len(re.findall("[A-Z]", text))
    doubles = len(lines) - len(set(lines))
    fails = [n < 20, 100 * len(inside) > 30 * n, 3 * symbols > n, chars < 2 * n or chars > 20 * n, 2 * doubles > len(lines), 2 * upper > chars]
    bits = sum(1 << k for k, x in enumerate(fails) if x)
    return n, chars, symbols, doubles, len(inside), bits, bool(bits & 3), not bits


# --- lines -------------------------------------------------------------------


def drop_lines(rows, ratio=0.1, least=5):
    """Rows with the boilerplate lines of their source taken out."""
    pages, holding = Counter(), Counter()
    for row in rows:
        pages[row[3]] += 1
        for line in {x.strip(SPACE) for x in (row[1] or "").split("\n")} - {""}:
            holding[row[3], line] += 1
    bad = {k for k, n in holding.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for doc_id, text, lang, source, n in rows:
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if (source, x.strip(SPACE)) not in bad)
        out.append((doc_id, text, lang, source, n if text is None else len(text)))
    return out


# --- near duplicates ---------------------------------------------------------


def shingles(text):
    w = words(lowered(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows):
    """The component of every id, by comparing all pairs."""
    sets = defaultdict(set)
    for doc_id, text, *_ in rows:
        sets[doc_id].add(shingles(text))
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(k for k in sets if k is not None)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in ids}


# --- mixing ------------------------------------------------------------------


def fill(budget, children):
    """Shares of ``children`` (name, cap, weight): those that can't use their share leave the rest to the others."""
    got, left = {}, [c for c in children if c[2] > 0]
    got.update({c[0]: 0 for c in children if c[2] <= 0})
    while left:
        weight = sum(c[2] for c in left)
        full = [c for c in left if c[1] * weight <= c[2] * budget]
        if not full:
            got.update({c[0]: c[2] * budget // weight for c in left})
            break
        first = min(full, key=lambda c: c[1] / c[2])
        got[first[0]] = first[1]
        budget -= first[1]
        left.remove(first)
    return got


def mix(rows, recipe):
    """How often each row is taken."""
    domain = lambda source: next((d for d, names in recipe.domains.items() if source in names), recipe.default_domain)
    keyed = [(domain(r[3]), r[2], r[3], r[0], len(words(r[1]))) for r in rows]
    supply = Counter()
    for d, lang, source, _, n in keyed:
        supply[d, lang, source] += n
    weight = lambda k: min(t.get(name, recipe.default_weight) for name, t in zip(k, (recipe.domain_weights, recipe.lang_weights, recipe.source_weights), strict=True))
    cap = {k: n * recipe.max_epochs if weight(k) > 0 else 0 for k, n in supply.items()}
    for d, lang, source, *_ in keyed:
        cap.setdefault((d, lang, source), 0)
    part = lambda name, table: table.get(name, recipe.default_weight)
    budget = min(sum(supply.values()) * recipe.share // 100, sum(cap.values()))
    alloc = {}
    tops = fill(budget, [(d, sum(v for k, v in cap.items() if k[0] == d), part(d, recipe.domain_weights)) for d in {k[0] for k in cap}])
    for d, top in tops.items():
        mids = fill(top, [(lang, sum(v for k, v in cap.items() if k[:2] == (d, lang)), part(lang, recipe.lang_weights)) for lang in {k[1] for k in cap if k[0] == d}])
        for lang, mid in mids.items():
            lows = fill(mid, [(k[2], v, part(k[2], recipe.source_weights)) for k, v in cap.items() if k[:2] == (d, lang)])
            alloc.update({(d, lang, source): n for source, n in lows.items()})
    out, leaves = [0] * len(rows), defaultdict(list)
    for at, (d, lang, source, doc_id, n) in enumerate(keyed):
        leaves[d, lang, source].append((at, doc_id, n))
    for leaf, members in leaves.items():
        epochs = alloc[leaf] // supply[leaf] if supply[leaf] else 0
        rest = alloc[leaf] - epochs * supply[leaf]
        seeded = lambda doc_id, e=epochs: hashlib.md5(f"{recipe.seed}:{e}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        total = Counter()
        for _, doc_id, n in members:
            total[seeded(doc_id)] += n
        upto, run = {}, 0
        for h in sorted(total):
            run += total[h]
            upto[h] = run
        for at, doc_id, _ in members:
            out[at] = epochs + (rest > 0 and upto[seeded(doc_id)] <= rest)
    return out


# --- personal data -----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def personal(text):
    """Kind, start and end of the base spans."""
    return [(kind, m.start(), m.end()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
