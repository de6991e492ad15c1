"""Plain versions of hard negatives, token files and spelling variants."""

import re
import zlib
from collections import Counter
from math import floor, isfinite


def negatives(rows, relabel=7, every=100):
    held = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v):
            held.append((i, (label + 1) % 10 if i % relabel == 0 else label, [floor(256 * float(x)) for x in v]))
    out = []
    for a, la, va in held:
        if a % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in held if i != a and len(v) == len(va))
            for s, p, _ in [x for x in scores if x[2] == la][:5]:
                hard = [x for x in scores if x[2] != la and -30 * s <= -100 * x[0] <= -90 * s][:10]
                out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(hard)]
    return sorted(out)


def counted(rows, changed=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % changed == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    """word -> (form, root, n, n_near, form_n); neighbours are looked for by lengths."""
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    found = {}
    for w, n in words.items():
        around = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, ()) if near(w, x)]
        best = min(((-words[x], x) for x in around), default=None)
        found[w] = (best[1] if best and -best[0] >= 10 * n else None, n, len(around), -best[0] if best and -best[0] >= 10 * n else None)
    out = {}
    for w, (form, n, around, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (form, root, n, around, form_n)
    return out
