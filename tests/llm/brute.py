"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^ \t-\r]+")


def sha(x):
    return hashlib.sha256(x).hexdigest()


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def repeated_bytes(rows, length=200):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone) if not y))))
    return sorted(out, key=str)


def near_classes(rows, n=3, num=90, den=100):
    sets = []
    for _, t in rows:
        w = WORD.findall(lowered(t or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter()
        for g in s:
            shared.update(index[g])
            index[g].append(i)
        for j, k in shared.items():
            if k * den >= num * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return sorted([(d, len(sets[i]), min(ids[find(i)], default=None)) for i, (d, _) in enumerate(rows)], key=str)


def earlier_windows(rows, window=50):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out, key=str)


def contaminated(docs, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = split(t)
        hit, own = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    own |= windows[k]
        names = sorted(str(x) for x in own if x is not None)
        out.append((d, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit)))
    return sorted(out, key=str)
