"""Plain versions of what the operators must return, for small tables."""

import hashlib
import re

import numpy as np

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def spans_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    by_token = {}
    for i, s in sets.items():
        for t in s:
            by_token.setdefault(t, []).append(i)
    pairs = {(a, b) for ids in by_token.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    edges = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, edges)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def vector_links(rows, threshold):
    def fit(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float), c) for i, v, c in rows if c is not None and fit(v)]
    edges, links = [], {i: 0 for i, _, _ in rows}
    for n, (a, x, c) in enumerate(good):
        for b, y, d in good[n + 1 :]:
            if c == d and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                edges.append((a, b))
                links[a] += 1
                links[b] += 1
    comp = components(list(links), edges)
    return {i: (links[i], comp[i], comp[i] == i) for i in links}
