"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import math
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def groups(items, linked):
    """Smallest member of the component of each item."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return dot / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def shingles(text, words):
    found = WORD.findall((text or "").encode().lower())
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)}


def jaccard_links(texts, words, similarity):
    sets = {i: shingles(t, words) for i, t in texts.items()}

    def linked(a, b):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        return both * similarity[1] >= either * similarity[0] and either > 0

    return sets, groups(sorted(texts), linked)


def deleted_lines(texts, min_words):
    """Numbers (document, line) of the lines in a maximal run of ``min_words`` words or more that
    occurred before. ``texts`` is a list in order; blank lines count for nothing."""
    seq, where = [], []
    for d, text in enumerate(texts):
        for i, line in enumerate((text or "").split("\n")):
            if line.encode().split():
                seq.append(line)
                where.append((d, i))
        seq.append(None)
        where.append(None)
    gone = set()
    for i in range(len(seq)):
        best = 0
        for j in range(i):
            k = 0
            while (i + k < len(seq) and seq[i + k] is not None and seq[i + k] == seq[j + k]):
                k += 1
            best = max(best, k)
        if sum(len(seq[x].encode().split()) for x in range(i, i + best)) >= min_words:
            gone |= {where[x] for x in range(i, i + best)}
    return gone


def water_fill(sizes, weights, repeats):
    """Targets by sharing again and again what exceeds the limits."""
    total, capped = sum(sizes), {}
    while True:
        left = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(capped.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = [i for i in left if share[i] > repeats * sizes[i]]
        if not over:
            return [capped.get(i, share.get(i)) for i in range(len(sizes))]
        capped |= {i: repeats * sizes[i] for i in over}
