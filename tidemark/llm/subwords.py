"""Character n-grams of words, hashed into a table with numpy: shared by the two text classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import Hasher, mix, text_bytes

#: Word bytes: ASCII letters and digits, and all bytes of longer characters.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(0x80, 0x100)]] = True
_WORD.setflags(write=False)

HASH = Hasher(11)
_GRAM = [np.random.Generator(np.random.PCG64(100 + k)).integers(1, 2**63, 257, dtype=np.int64).view(np.uint64) for k in range(8)]
U = np.uint64


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(column))


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word's number for each row (rows + 1)."""
    ink = _WORD[data]
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    full = bounds[:-1] < bounds[1:]
    starts[bounds[:-1][full]] = ink[bounds[:-1][full]]
    ends[bounds[1:][full] - 1] = ink[bounds[1:][full] - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, bounds)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, a place where it stands, for each word the number of its distinct word)."""
    hashes = HASH.words(data, starts, ends)
    keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return keys, at, inverse


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, sizes: tuple[int, ...], buckets: int, affixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word (with marks at both ends) and of the word itself: flat, and bounds (words + 1).

    affixes: the first and the last 2 and 3 bytes of a word count in buckets of their own as well.
    """
    lengths = ends - starts
    padded = lengths + 2
    stop = np.cumsum(padded)
    begin = stop - padded
    flat = np.full(int(stop[-1]) if len(stop) else 0, 256, dtype=np.int64)
    inner = np.repeat(begin + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    flat[inner] = data[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
    owner = np.repeat(np.arange(len(starts)), padded)
    found, owners = [(mix(hashes) % U(buckets)).astype(np.int64)], [np.arange(len(starts))]
    total = np.zeros(len(flat), dtype=U)
    done = 0
    for n in sorted(sizes):
        for k in range(done, n):
            total[: len(flat) - k] += _GRAM[k][flat[k:]] * U(2 * k + 1)
        done = n
        ok = np.zeros(len(flat), dtype=bool)
        if len(flat) >= n:
            ok[: len(flat) - n + 1] = owner[: len(flat) - n + 1] == owner[n - 1 :]
        found.append((mix(total[ok] + U(n)) % U(buckets)).astype(np.int64))
        owners.append(owner[ok])
    if affixes:
        for n in (2, 3):
            has = lengths >= n
            for kind, base in ((1, starts[has]), (2, ends[has] - n)):
                h = np.full(int(has.sum()), 1000 * kind + n, dtype=U)
                for k in range(n):
                    h += _GRAM[k][data[base + k]] * U(2 * k + 1)
                found.append((mix(mix(h)) % U(buckets)).astype(np.int64))
                owners.append(np.flatnonzero(has))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(starts)))])


#: Distinct words whose n-grams are held at a time.
CHUNK = 16_384


def word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, sizes: tuple[int, ...], table: np.ndarray, affixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table rows (columns x buckets) over the n-grams of each word, and their numbers."""
    out, n = [], []
    for i in range(0, len(starts), CHUNK):
        part = slice(i, i + CHUNK)
        flat, of = grams(data, starts[part], ends[part], hashes[part], sizes, table.shape[1], affixes)
        out.append(gathered(table, flat, of))
        n.append(np.diff(of))
    return np.concatenate(out), np.concatenate(n)


def gathered(table: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of table rows (columns x buckets, 2-D) over the slices flat[bounds[i]:bounds[i + 1]], none empty."""
    return np.stack([np.add.reduceat(column[flat], bounds[:-1]) for column in table], 1)


def scattered(flat: np.ndarray, values: np.ndarray, buckets: int) -> np.ndarray:
    """The reverse: values (rows x columns) added up by bucket, as columns x buckets."""
    return np.stack([np.bincount(flat, values[:, k], buckets) for k in range(values.shape[1])])
