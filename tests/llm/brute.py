"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

UPPER = {i: i + 32 for i in range(65, 91)}


def folded(text):
    return (text or "").translate(UPPER)


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def components(rows, words, num, den):
    """key -> smallest key that links reach; rows are (key, text)."""
    sets = [(k, shingles(t, words)) for k, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), k), k)
    return {k: low[find(i)] for i, (k, _) in enumerate(sets)}, {k: len(s) for k, s in sets}


def exact(rows):
    """(key, keep, size, sha) of rows (key, text)."""
    groups = defaultdict(list)
    for k, t in rows:
        groups[hashlib.sha256(folded(t).encode()).hexdigest()].append(k)
    return sorted((k, max(ks), len(ks), sha) for sha, ks in groups.items() for k in ks)
