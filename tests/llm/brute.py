"""Plain versions of what the operators compute."""

import re

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, width=5):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    w = SPACE.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def jaccard_components(rows, percent=80):
    sets = {i: shingle_set(t) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in by.values() for x, a in enumerate(ids) for b in ids[x + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    r = roots(sets, links)
    return {i: (len(s), r[i]) for i, s in sets.items()}
