"""Plain versions of the operators, for small tables."""

import hashlib
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(text):
    return (text or "").translate(UP)


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[folded(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[folded(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(folded(t).encode()).hexdigest()))
    return out


def near(rows, words, percent):
    sets = []
    for _, t in rows:
        w = folded(t).encode().split()
        sets.append(frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = defaultdict(list)
    for n, s in enumerate(sets):
        common = Counter()
        for g in s:
            for m in having[g]:
                common[m] += 1
            having[g].append(n)
        for m, v in common.items():
            if 100 * v >= percent * (len(s) + len(sets[m]) - v):
                parent[find(n)] = find(m)
    lowest = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            lowest[find(n)] = min(lowest.get(find(n), i), i)
    out = []
    for n, (i, _) in enumerate(rows):
        component = lowest.get(find(n)) if sets[n] else i
        out.append((i, len(sets[n]), component, i == component))
    return out


def repeated_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def later_passages(rows, width):
    far = float("inf")
    texts = [(far if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, far), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if i == far else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def edit_distance_in(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, c in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (p != c)))
        before = now
    return min(before)


def same(got, expected):
    assert sorted(map(str, got)) == sorted(map(str, expected))
