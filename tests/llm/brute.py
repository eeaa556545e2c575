"""Plain single-process versions of the operators, for small inputs."""

import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(text, width=3):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    width = min(width, len(words))
    votes = [0] * 64
    n = len(words) - width + 1
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum((2 * v > n) << b for b, v in enumerate(votes))


def simhash_classes(docs):
    """docs: (doc_id, text); doc_id -> (fingerprint, component)."""
    fps = {i: simhash(t) for i, t in docs}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (fps[a] ^ fps[b]).bit_count() <= 2]
    comp = components(ids, links)
    return {i: (fps[i], comp[i]) for i in ids}


def repeats(docs, size=35):
    """docs: (doc_id, text); list of (doc_id, n_words, removed word indexes)."""
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    seen = defaultdict(int)
    for _, w in words:
        for a in range(len(w) - size + 1):
            seen[tuple(w[a:a + size])] += 1
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - size + 1):
            if seen[tuple(w[a:a + size])] > 1:
                gone.update(range(a, a + size))
        out.append((i, w, gone))
    return out
