"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LOW = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW if lower else {}))


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, size=5):
    w = words(text, True)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard(rows):
    """``[(doc_id, n, component)]`` of ``[(doc_id, text)]``."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    label = components(len(rows), links)
    least = defaultdict(list)
    for (d, _), c in zip(rows, label):
        least[c].append(d)
    known = {c: min([d for d in v if d is not None], default=None) for c, v in least.items()}
    return [(d, len(s), known[c] if s else d) for (d, _), s, c in zip(rows, sets, label)]


def substrings(rows, size=20):
    """``[(doc_id, n, removed, kept)]``; documents in order of doc_id, null first, equal ids side by side."""
    first = {}
    split = [(d, words(t)) for d, t in rows]
    place = lambda d, p: (d is not None, d or 0, p)
    for d, w in split:
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            first[k] = min(first.get(k, place(d, p)), place(d, p))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p:p + size])] < place(d, p):
                gone[p:p + size] = [True] * size
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def contamination(rows, items, size=13):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[p:p + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        found = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), found, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def within_one(a, b):
    """An edit distance of one or none, by what both ends share."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    front = next((i for i in range(short) if a[i] != b[i]), short)
    back = next((i for i in range(short) if a[-i - 1] != b[-i - 1]), short)
    return front + back >= max(len(a), len(b)) - 1


def removed_lines(rows, least=5):
    """``[(doc_id, [line numbers])]``: copies of lines of any length, and one-word edits from ``least`` words on."""
    place = lambda d, i: (d is not None, d or 0, i)
    lines = [(r, place(d, i), tuple(x.split(" "))) for r, (d, t) in enumerate(rows) if t is not None
             for i, x in enumerate(t.split("\n")) if x]
    gone = defaultdict(list)
    for r, at, w in lines:
        if any(other < at and (v == w or min(len(v), len(w)) >= least and within_one(v, w)) for _, other, v in lines):
            gone[r].append(at[2])
    return [(d, gone[r]) for r, (d, _) in enumerate(rows)]


def counted(texts):
    c = Counter()
    for t in texts:
        c.update([*words(t, True), "\n"])
    return c
