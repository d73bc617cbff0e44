"""Plain loops that say what the operators must return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def substring_dedup(docs, width=13):
    """(doc_id, n_words, n_removed, sha) of each (doc_id, text), and the reach."""
    last = float("inf")
    rank = lambda i: last if i is None else i
    first, out = {}, []
    for i, text in docs:
        w = words(text)
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            first[k] = min(first.get(k, last), rank(i))
    for i, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < rank(i):
                gone[p:p + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        reach, size = 0, width
        while any(len(words(t)) >= size for _, t in docs):
            seen = defaultdict(set)
            for j, t in docs:
                v = words(t)
                for p in range(len(v) - size + 1):
                    seen[tuple(v[p:p + size])].add(rank(j))
            if any(len(seen[tuple(w[p:p + size])]) > 1 for p in range(len(w) - size + 1)):
                reach = size
            size *= 2
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), reach))
    return out


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[p:p + size]) for p in range(len(w) - size + 1))


def jaccard_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    groups = Union()
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                groups.join(i, j)
    return [(i, len(s), None if i is None else groups.find(i)) for i, s in sets]


def line_dedup(docs):
    """(doc_id, n_lines, n_removed, kept text) of each (doc_id, text)."""
    last = float("inf")
    lines = []
    for d, (i, text) in enumerate(docs):
        for j, line in enumerate((text or "").split("\n")):
            lines.append((last if i is None else i, d, j, frozenset(words(line))))
    gone = set()
    for r, d, j, s in lines:
        for r2, d2, j2, t in lines:
            earlier = r2 < r or (d2 == d and j2 < j)
            if s and t and earlier and 100 * len(s & t) >= 80 * len(s | t):
                gone.add((d, j))
                break
    out = []
    for d, (i, text) in enumerate(docs):
        all_ = (text or "").split("\n")
        kept = "\n".join(x for j, x in enumerate(all_) if (d, j) not in gone)
        out.append((i, len(all_), len(all_) - sum((d, j) not in gone for j in range(len(all_))), kept))
    return out


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[p:p + 5]) for p in range(len(w) - 4))
    covered = set()
    for p in range(len(w) - 4):
        if windows[tuple(w[p:p + 5])] > 1:
            covered.update(range(p, p + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def weak_votes(text):
    """The ten labellers' votes (0 none, 1 bad, 2 good), one rule after the other."""
    text = text or ""
    w = words(text)
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = base_counts(text)
    if n_words < 10:
        return [0] * 10
    byte = text.encode()
    upper = sum(65 <= b <= 90 for b in byte)
    lower = sum(97 <= b <= 122 for b in byte)
    solid = sum(b not in b" \t\n\x0b\x0c\r" for b in byte)
    other = sum(b >= 128 for b in byte)
    stops = text.count(".")
    marked = sum(any(c in "#*$%&|<>" for c in x) for x in w)

    def vote(bad, good, known=True):
        return 0 if not known else 1 if bad else 2 if good else 0

    letters = (upper + lower + other) / solid
    capitals = upper / max(upper + lower, 1)
    variety = len(set(w)) / n_words
    span = n_words / max(stops, 1)
    length = word_chars / n_words
    return [
        vote(n_symbols / n_words > 0.05, n_symbols / n_words < 0.02),
        vote(marked / n_words > 0.1, marked / n_words < 0.03),
        vote(letters < 0.9, letters > 0.94),
        vote(n_repeat / n_words > 0.2, n_repeat / n_words < 0.05),
        vote(capitals > 0.3, capitals < 0.15),
        vote(text.count("!") / n_words > 0.1, text.count("!") / n_words < 0.05),
        vote(variety < 0.15, variety > 0.4, n_words >= 20),
        vote(stops == 0 or span > 80, 2 < span < 40, n_words >= 30),
        vote(n_dup_lines > 3, n_dup_lines == 0),
        vote(length > 12 or length < 2, 3 < length < 9),
    ]
