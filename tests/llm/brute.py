"""Plain versions of the operators, for small tables."""

import collections
import re


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def shingles(text, k=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs, percent=80):
    """docs: (id, text) -> {id: (set size, smallest linked id)}"""
    sets = {i: shingles(t) for i, t in docs}
    having = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    shared = collections.Counter((a, b) for group in having.values() for n, b in enumerate(sorted(group)) for a in sorted(group)[:n])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(docs, n):
    """docs: (id, text) -> {id: (words, kept words)}"""
    first = {}
    split = [(i, words(t)) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in split:
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        out[i] = (w, [x for j, x in enumerate(w) if j not in gone])
    return out


def quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def leaks(docs, items, k=5, least=0.8):
    """The best window of each document for each item, of all windows of the item's size, by multiset similarity of shingles."""
    def grams(w, n):
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    out = {}
    wanted = [(item, grams(w, min(k, len(w))), min(k, len(w))) for item, t in items if (w := words((t or "").lower()))]
    for d, t in docs:
        w = words((t or "").lower())
        held = {n: grams(w, n) for n in {x for _, _, x in wanted}}
        seen = {n: set(g) for n, g in held.items()}
        for item, want, n in wanted:
            if seen[n].isdisjoint(want):
                continue
            whole = collections.Counter(want)
            for s in range(1 - len(want), len(held[n])):
                window = held[n][max(0, s) : s + len(want)]
                both = sum((collections.Counter(window) & whole).values())
                rate = both / (len(window) + len(want) - both)
                if rate >= least:
                    out[d, item] = max(rate, out.get((d, item), 0))
    return out
