"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def groups(texts, size, percent):
    """Per text, the size of its set and the smallest place it is linked with."""
    sets = [shingle_set(t, size) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def repeats(texts, length):
    """Per text: bytes, removed bytes, removed runs, digest of the rest, the rest."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    found = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        rest = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        found.append((len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return found
