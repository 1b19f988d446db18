"""Bounded-space online packing of token sequences into windows of a fixed length.

Each partition keeps at most OPEN windows. Whole windows are cut off the front of a document; the rest
goes to the open window that it fits best. When none fits, the fullest is emitted: if its gap is larger
than MAX_PAD tokens, the head of the document is cut off to fill it. What a partition still has open at its
end is merged with the leftovers of neighbouring partitions (MERGE_PARTITIONS at a time, at most OPEN
windows each, so a merging task has a fixed bound), best-fit by decreasing length.

The pieces are written to a table before the leftovers are merged: a lost executor repeats whole
partitions before, and none after.

Defined results: a null or empty text is the end token alone; repeated rows (and null ids) are packed
each for itself; a document of any length is cut; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoded
from tidemark.llm.common import bounded_batches, cut, give_back, texts

#: Open windows of a partition.
OPEN = 32
#: Tokens of padding that an emitted window may keep instead of cutting a document.
MAX_PAD = 16
#: Partitions whose leftovers meet in one merging group.
MERGE_PARTITIONS = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean"


class Packer:
    """Bounded-space best-fit. add() and close() give (document, start, length, window, offset, leftover)."""

    def __init__(self, size: int, open_windows: int = OPEN, max_pad: int = MAX_PAD):
        self.size, self.most, self.max_pad = size, open_windows, max_pad
        self.open: dict[int, list] = {}
        self.used: dict[int, int] = {}
        self.made = 0

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _emit(self, w: int, leftover: bool = False) -> Iterator[tuple]:
        del self.used[w]
        for doc, start, length, offset in self.open.pop(w):
            yield doc, start, length, w, offset, leftover

    def _place(self, w: int, doc, start: int, length: int) -> None:
        self.open[w].append((doc, start, length, self.used[w]))
        self.used[w] += length

    def add(self, doc, n: int) -> Iterator[tuple]:
        start = 0
        while n - start >= self.size:
            yield doc, start, self.size, self._new(), 0, False
            start += self.size
        while (rest := n - start) > 0:
            fits = [w for w, u in self.used.items() if u + rest <= self.size]
            if fits:
                w = max(fits, key=self.used.__getitem__)
                self._place(w, doc, start, rest)
                if self.used[w] == self.size:
                    yield from self._emit(w)
                return
            if len(self.open) < self.most:
                w = self._new()
                self.open[w], self.used[w] = [], 0
                continue
            w = max(self.used, key=self.used.__getitem__)
            gap = self.size - self.used[w]
            if gap > self.max_pad:
                self._place(w, doc, start, gap)
                start += gap
            yield from self._emit(w)

    def close(self) -> Iterator[tuple]:
        for w in list(self.open):
            yield from self._emit(w, True)


def best_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """For each length (bin, offset), placed best-fit from the longest to the shortest."""
    used: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b, u in enumerate(used) if u + lengths[i] <= size]
        b = max(fits, key=used.__getitem__) if fits else len(used)
        if not fits:
            used.append(0)
        out[i] = (b, used[b])
        used[b] += lengths[i]
    return out


def pack(docs: DataFrame, vocab_path: str, size: int = 2048, end_id: int = 1, open_windows: int = OPEN, max_pad: int = MAX_PAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    tail = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(size, open_windows, max_pad), TaskContext.get().partitionId() << 32
        ids: dict[int, tuple] = {}  # documents with pieces in open windows
        n = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            out = []
            for key, start, length, w, offset, leftover in pieces:
                doc_id, raw = ids[key]
                out.append((doc_id, start, length, zlib.crc32(raw[start : start + length].tobytes()), len(raw), first + w, offset, leftover))
            waiting = {p[0] for w in packer.open.values() for p in w}
            for key in [k for k in ids if k not in waiting]:
                del ids[key]
            columns = list(zip(*out, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=[c.split()[0] for c in PIECES.split(", ")])

        for doc_ids, tokens in encoded(batches, vocab_path):
            done = []
            for doc_id, raw in zip(doc_ids, tokens, strict=True):
                ids[n] = (doc_id, np.append(raw, tail))
                done.extend(packer.add(n, len(raw) + 1))
                n += 1
            yield rows(done)
        yield rows(list(packer.close()))
        ids.clear()
        give_back()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("window")
        placed = best_fit(group["used"].tolist(), size)
        windows = group["window"].tolist()
        names: dict[int, int] = {}
        for w, (b, _) in zip(windows, placed, strict=True):
            names.setdefault(b, w)
        return pd.DataFrame({"window": windows, "into": [names[b] for b, _ in placed], "shift": [o for _, o in placed]})

    bounded_batches(docs.sparkSession)
    pieces = cut(texts(docs, id_col, text_col).mapInArrow(run, PIECES), "pieces")
    left = pieces.where("leftover")
    moved = (
        left.groupBy(F.col("sequence_id").alias("window"))
        .agg(F.sum("length").alias("used"))
        .groupBy(F.floor(F.shiftright("window", 32) / MERGE_PARTITIONS).alias("_group"))
        .applyInPandas(merge, "window long, into long, shift long")
    )
    merged = left.join(moved, F.col("sequence_id") == F.col("window")).withColumns({"sequence_id": F.col("into"), "offset": F.col("offset") + F.col("shift")})
    columns = [c.split()[0] for c in PIECES.split(", ")][:-1]
    return pieces.where("not leftover").select(columns).unionAll(merged.select(columns))
