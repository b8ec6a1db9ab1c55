"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows):
    """(doc_id, set size, least reachable id) of each row; rows of one id are one node."""
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            sets[i].add(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [(i, len(shingles(t)), None if i is None else find(i)) for i, t in rows]


def removal(rows, span=35):
    starts = Counter()
    for _, t in rows:
        w = words(t)
        starts.update(tuple(w[k : k + span]) for k in range(len(w) - span + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - span + 1):
            if starts[tuple(w[k : k + span])] > 1:
                gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def statistics(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def multiset(rows):
    return Counter(map(tuple, rows))


def folded_words(text):
    """Words without the case of ASCII and Latin-1 letters, cut at ASCII characters other than letters and digits."""
    out = []
    for c in text or "":
        if ord(c) < 128 and not c.isalnum():
            c = " "
        elif c.isascii() or 0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7:
            c = c.lower()
        out.append(c)
    return WORD.findall("".join(out))


def tiled_words(item, text, m):
    """Words of ``item`` in greedy tiles: the longest match of free words is marked again and again."""
    free_item, free_text, total = [True] * len(item), [True] * len(text), 0
    at = defaultdict(list)
    for j, w in enumerate(text):
        at[w].append(j)
    while True:
        best = (0, 0, 0)
        for i, w in enumerate(item):
            for j in at[w]:
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < m:
            return total
        total += n
        free_item[i : i + n] = free_text[j : j + n] = [False] * n


def contaminated(docs, items, m=5, threshold=0.5):
    """(doc_id, item_id, coverage) of all pairs that reach the threshold."""
    out = []
    known = [(k, w, {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}) for k, t in items if len(w := folded_words(t)) >= m]
    for d, t in docs:
        text = folded_words(t)
        grams = {tuple(text[i : i + m]) for i in range(len(text) - m + 1)}
        for k, w, own in known:
            if own & grams and (share := tiled_words(w, text, m) / len(w)) >= threshold:
                out.append((d, k, share))
    return out
