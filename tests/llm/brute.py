"""Plain single-machine versions of what the operators return."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def near_classes(rows):
    """doc_id -> (n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    seen = set()
    for group in holders.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(rows, n=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    counts = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for j in range(len(b) - n + 1):
            counts[b[j : j + n]] += 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if counts[b[j : j + n]] > 1:
                gone[j : j + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def edit_distance(a, b):
    """Least distance of a to any run of b, over words."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)
