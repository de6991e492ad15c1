"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def removed(rows, width=200):
    counts = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        counts.update(b[s : s + width] for s in range(len(b) - width + 1))
    out = defaultdict(list)
    for i, b in data:
        marks = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if counts[b[s : s + width]] > 1:
                marks[s : s + width] = b"\1" * width
        kept = bytes(x for x, m in zip(b, marks, strict=True) if not m)
        spans = sum(1 for j in range(len(marks)) if marks[j] and (j == 0 or not marks[j - 1]))
        out[i].append((len(b), sum(marks), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def joined(parents, a, b):
    parents[max(root(parents, a), root(parents, b))] = min(root(parents, a), root(parents, b))


def root(parents, x):
    while parents[x] != x:
        x = parents[x]
    return x


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def clustered(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    places = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            places[x].append(k)
    both = Counter()
    for listed in places.values():
        both.update((a, b) for n, b in enumerate(listed) for a in listed[:n])
    parents = list(range(len(sets)))
    for (a, b), c in both.items():
        if 100 * c >= 80 * (len(sets[a][1]) + len(sets[b][1]) - c):
            joined(parents, a, b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(parents, k)
        least[r] = i if r not in least else min(least[r], i)
    return sorted((i, len(s), least[root(parents, k)]) for k, (i, s) in enumerate(sets))


def linked_vectors(rows):
    units = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            u = np.array(v, np.float32).astype(float)
            if (length := np.sqrt(u @ u)) > 0:
                units[i] = u / length
    links, parents = Counter(), {i: i for i, _ in rows}
    ids = sorted(units)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                joined(parents, a, b)
    return {i: (links[i], root(parents, i)) for i, _ in rows}
