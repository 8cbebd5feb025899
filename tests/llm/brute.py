"""Plain Python versions of the operators' results."""

import re
from collections import Counter

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def shingle_set(text, width):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def components(docs, percent, width):
    """docs: (id, text) pairs; {id: (set size, smallest id reachable)}."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holds = {}
    for i, s in sets.items():
        for x in s:
            holds.setdefault(x, []).append(i)
    seen = set()
    for group in holds.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def quality(text):
    text = text or ""
    w = words(text)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    covered = {j for i, t in enumerate(triples) if often[t] > 1 for j in (i, i + 1, i + 2)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)
