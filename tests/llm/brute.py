"""The contracts, computed plainly over small lists of documents."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, window=13):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest) per row."""
    found = defaultdict(set)
    for item_id, text in items:
        w = benchmark_words(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            found[tuple(w[j : j + n])].add((item_id, j))
    out = []
    for doc_id, text in docs:
        w, hit, ids, diagonals = benchmark_words(text), set(), set(), defaultdict(set)
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                for item_id, j in found.get(tuple(w[i : i + n]), ()):
                    hit.update(range(i, i + n))
                    ids |= {str(item_id)} if item_id is not None else set()
                    diagonals[item_id, i - j, n].add(i)
        longest = 0
        for (_, _, n), starts in diagonals.items():
            for s in starts:
                if s - 1 not in starts:
                    e = s
                    while e + 1 in starts:
                        e += 1
                    longest = max(longest, e - s + n)
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w), longest))
    return out


def spans(texts, length=400):
    """Maximal runs of bytes that lie in a repeated string, per text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        runs = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if runs and runs[-1][1] >= i:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append(runs)
    return out


def cut(text, runs):
    kept, at = b"", 0
    for a, b in runs:
        kept, at = kept + text[at:a], b
    return kept + text[at:]


def repeats(docs, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    texts = [(t or "").encode() for _, t in docs]
    out = []
    for (doc_id, _), text, runs in zip(docs, texts, spans(texts, length), strict=True):
        kept = cut(text, runs)
        out.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5):
    w = space_words(text)
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id, kept)}."""
    sets = {d: shingles(t) for d, t in docs if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
