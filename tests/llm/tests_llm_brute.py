"""Brute-force versions that tests of the pipeline use."""

from collections import Counter, defaultdict

import re


def components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in where[g])
        for j, n in common.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in sets[i]:
            where[g].append(i)
    return {i: root(i) for i in sets}


def removed_text(texts, window=50):
    """Texts without the bytes that windows of earlier documents cover; broken characters go."""
    seen, out = {}, {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen.setdefault(t[p : p + window], i) < i:
                gone[p : p + window] = b"\1" * window
        out[i] = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    return out
