"""Brute-force versions of the operators' results, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(docs: list[tuple], length: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    words = [WORD.findall(t or "") for _, t in docs]
    smallest: dict[tuple, int] = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - length + 1 if i is not None else 0):
            key = tuple(w[k : k + length])
            smallest[key] = min(i, smallest.get(key, i))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            first = smallest.get(tuple(w[k : k + length]))
            if i is not None and first is not None and first < i:
                gone.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2)


def simhash(docs: list[tuple], distance: int = 4) -> list[tuple]:
    """(doc_id, fingerprint, component_id)."""
    fps = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f] = parent[parent[f]]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for (i, _), f in zip(docs, fps, strict=True):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for (i, _), f in zip(docs, fps, strict=True)]
