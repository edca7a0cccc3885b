"""Plain single-process versions of the training-data operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def ascii_lower(s: str) -> str:
    return s.encode().lower().decode()


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def decontaminate(docs, bench, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: word.findall(ascii_lower(t or ""))
    wins = defaultdict(set)
    for item, t in bench:
        w = of(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[i:i + k])].add("" if item is None else str(item))
    sizes = {len(x) for x in wins}
    out = []
    for doc, t in docs:
        w, hit, items = of(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                got = wins.get(tuple(w[i:i + k]))
                if got:
                    hit.update(range(i, i + k))
                    items |= got
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def line_dedup(docs, min_docs=10, min_chars=1):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for doc, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and seen[key(x)] >= min_docs)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def substring_dedup(docs, n=35):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(docs, words):
        cut = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                cut.update(range(i, i + n))
        out.append((doc, len(w), len(cut), b" ".join(x for i, x in enumerate(w) if i not in cut).decode()))
    return out


def shingles(text, n):
    w = ascii_lower(text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_dedup(docs, n=5, percent=80):
    """docs with distinct, non-null ids."""
    sets = {d: shingles(t, n) for d, t in docs}
    at = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            at[g].append(d)
    u = Union()
    for d, s in sets.items():
        for e, both in Counter(e for g in s for e in at[g] if e > d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                u.join(d, e)
    return {d: (len(s), u.find(d)) for d, s in sets.items()}
