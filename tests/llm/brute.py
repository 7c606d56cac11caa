"""Plain brute-force versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile("[a-z0-9]+")


def words(text):
    return WORD.findall((text or "").lower())


def similar(a, b, num=3, den=5):
    x, y = set(words(a)), set(words(b))
    return bool(x and y) and den * len(x & y) >= num * len(x | y)


def last(rows):
    """{id: row} of the last deliveries; rows are (id, at, ...)."""
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]] = r
    return out


def groups(texts):
    """Pairs of ids in one group, by closing similarity over all pairs."""
    ids = [i for i, t in texts.items() if words(t)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if similar(texts[a], texts[b]):
                root[find(a)] = find(b)
    by = defaultdict(list)
    for i in ids:
        by[find(i)].append(i)
    return {(min(a, b), max(a, b)) for g in by.values() for k, a in enumerate(g) for b in g[k + 1 :]}


def leaks(docs, items, size=13):
    phrases = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - size + 1)):
            phrases[tuple(w[k : k + size])].add(i)
    lengths = {len(p) for p in phrases}
    out = set()
    for d, t in docs:
        w = words(t)
        for n in lengths:
            for k in range(len(w) - n + 1):
                out |= {(d, i) for i in phrases.get(tuple(w[k : k + n]), ())}
    return out
