"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, size=5):
    words = WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(rows, percent):
    """{doc: (set size, component)}; ``rows`` are (doc, text) with distinct docs."""
    sets = {d: shingle_set(t) for d, t in rows}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if (n := len(sets[a] & sets[b])) and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    found = components(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def repeated_bytes(texts, length):
    """For each text (bytes): which bytes a repeated string covers."""
    seen = Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    masks = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                mask[i: i + length] = True
        masks.append(mask)
    return masks


def runs(mask):
    return int((np.diff(np.concatenate([[0], mask.astype(int), [0]])) == 1).sum())


def vector_links(rows, threshold):
    """{key: (links, component)} of (key, embedding, label)."""
    good = {}
    for k, e, label in rows:
        if label is None or not e or any(x is None for x in e):
            continue
        v = np.array(e, float)
        if np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            good[k] = (v / np.linalg.norm(v), label)
    links = [
        (a, b) for a, b in combinations(good, 2)
        if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= threshold
    ]
    number = Counter(x for pair in links for x in pair)
    found = components([k for k, _, _ in rows], links)
    return {k: (number[k], found[k]) for k, _, _ in rows}


def quality(text):
    data = (text or "").encode()
    words = WORD.findall(data)
    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    cover = set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            cover.update(range(i, i + 8))
    chars = sum(len(w.decode()) for w in words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover),
        "base_failed": len(words) < 20 or 100 * len(cover) > 30 * len(words),
        "lines": len(lines),
    }


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc(data: bytes) -> int:
    return zlib.crc32(data)
