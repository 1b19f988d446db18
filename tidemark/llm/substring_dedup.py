"""Substring dedup: windows of 50 words that start in an earlier document are removed, found in two passes.

The documents are staged once as blocks: one row holds the texts of a batch, compressed. Pass one makes a
sketch of each block: every window adds one to a cell in each of DEPTH rows, counted to two at most; only
cells that are hit are written, in sorted stretches of a few bytes a cell. Sketches meet by stretch, where
merged counts overestimate how often a window occurs, and each block gets back one bit for each of its
cells: estimated once or repeatedly. The rows are CELLS_PER_WINDOW times as wide as there are windows, so
the share of windows estimated repeated without being so stays below 1 % at any size of the corpus.

Pass two takes the 128-bit XXH3 digest of the words of each window estimated repeated and groups by it, by
joins that Spark can split: no repeated window is lost, for a count never falls below the truth, and what
the sketch confuses is told apart. The smallest document of each group tells which windows go. Nothing but
counts of windows comes to the driver.

Defined results: words are split at ASCII white space; null and short texts have no windows and lose
nothing; rows with equal ids, and rows with a null id, neither remove nor are removed by one another
(a null id is nobody's smaller id, and isn't larger than one); repeated rows each give a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WIDE, Hasher, bounded_batches, cut, drop_tables, give_back, joined, map_batches, mix, text_bytes, window_starts, word_bounds

WINDOW = 50
DEPTH, CELLS_PER_WINDOW = 2, 16
#: Windows whose cells make one stretch of the sketch (a power of two).
STRETCH_WINDOWS = 1 << 20

HASH = Hasher(31)
BLOCKS = "block long, ids array<long>, bounds array<long>, texts binary, windows long"


def _windows(n_bits: int, first: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of all windows, and their cells in each row of the sketch."""
    starts = window_starts(first, length)
    h = HASH.runs(hashes, starts, length)
    shift = np.uint64(64 - n_bits)
    return starts, [(mix(h + np.uint64(d)) if d else h) >> shift for d in range(DEPTH)]


def _pack(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted cells with a flag each: of their differences the lower bits as they are, of the small rest a compressed byte."""
    step = np.diff(cells, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(cells[-1] // np.uint64(len(cells))).bit_length() - 1)
    planes = [np.packbits(twice), *(np.packbits((step >> np.uint64(i) & np.uint64(1)).astype(np.uint8)) for i in range(k))]
    high = np.ascontiguousarray((step >> np.uint64(k)).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return bytes([k]) + len(cells).to_bytes(8, "little") + b"".join(p.tobytes() for p in planes) + zstandard.compress(high.tobytes(), 3)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, n = raw[0], int.from_bytes(raw[1:9], "little")
    size = -(-n // 8)
    plane = lambda i: np.unpackbits(np.frombuffer(raw, np.uint8, size, 9 + i * size), count=n)
    high = np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw[9 + (k + 1) * size :]), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    step = high.astype(np.uint64) << np.uint64(k)
    for i in range(k):
        step |= plane(1 + i).astype(np.uint64) << np.uint64(i)
    return np.cumsum(step, dtype=np.uint64), plane(0).astype(bool)


def _stage(docs: DataFrame, id_col: str, text_col: str, carry: list[Column], length: int) -> DataFrame:
    rest = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(carry or [F.lit(0)])])
    kind = docs.select(rest.alias("rest")).schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        give_back()
        for b in batches:
            if b.num_rows:
                data, bounds = text_bytes(b.column(1))
                _, _, first = word_bounds(data, bounds)
                one = pa.array([0, b.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n]),
                        pa.ListArray.from_arrays(one, b.column(0)),
                        pa.array([bounds], pa.list_(pa.int64())),
                        pa.array([zstandard.compress(data.tobytes(), 1)], pa.binary()),
                        pa.array([int(np.maximum(np.diff(first) - length + 1, 0).sum())]),
                        pa.ListArray.from_arrays(one, b.column(2)),
                    ],
                    names=["block", "ids", "bounds", "texts", "windows", "rest"],
                )
                n += 1
                del b, data
                give_back()

    bounded_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    return cut(picked.mapInArrow(run, f"{BLOCKS}, rest array<{kind}>"), "blocks", **WIDE)


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """One block at a time as Python values; what the one before took is given back."""
    for k in range(b.num_rows):
        if k:
            give_back()
        yield tuple(c[k].as_py() for c in b.columns)


def _open(texts: bytes, bounds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.decompress(texts), np.uint8)
    starts, ends, first = word_bounds(data, np.array(bounds, dtype=np.int64))
    return data, starts, ends, first


def _sketches(blocks: DataFrame, n_bits: int, stretch_bits: int, length: int) -> DataFrame:
    """(depth, stretch, block, cells): the part of each block's sketch in each stretch of cells."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block, bounds, texts in _rows(b):
            data, starts, ends, first = _open(texts, bounds)
            _, rows = _windows(n_bits, first, HASH.words(data, starts, ends), length)
            del data, starts, ends
            for d, cells in enumerate(rows):
                cells = np.sort(cells)
                fresh = np.ones(len(cells), dtype=bool)
                fresh[1:] = cells[1:] != cells[:-1]
                at = np.flatnonzero(fresh)
                twice = np.diff(np.append(at, len(cells))) > 1
                cells = cells[at]
                stretch = (cells >> np.uint64(stretch_bits)).astype(np.int64)
                cut_at = np.flatnonzero(np.diff(stretch, prepend=-1))
                ends_at = np.append(cut_at[1:], len(cells))
                found = [(d, int(stretch[i]), block, _pack(cells[i:j] & np.uint64((1 << stretch_bits) - 1), twice[i:j])) for i, j in zip(cut_at.tolist(), ends_at.tolist(), strict=True)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["depth", "stretch", "block", "cells"])

    return map_batches(blocks.select("block", "bounds", "texts"), run, "depth int, stretch long, block long, cells binary")


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """For each block of a stretch: one bit for each of its cells, set if all blocks together hit it twice."""
    cells, twice = zip(*map(_unpack, part["cells"]), strict=True)
    every = np.concatenate(cells)
    order = np.argsort(every, kind="stable")
    fresh = np.ones(len(every), dtype=bool)
    fresh[1:] = every[order][1:] != every[order][:-1]
    at = np.flatnonzero(fresh)
    count = np.add.reduceat(1 + np.concatenate(twice)[order].astype(np.int64), at)
    repeated = np.empty(len(every), dtype=bool)
    repeated[order] = np.repeat(count > 1, np.diff(np.append(at, len(every))))
    stops = np.cumsum([len(c) for c in cells])
    bits = [np.packbits(repeated[j - len(c) : j]).tobytes() for c, j in zip(cells, stops, strict=True)]
    n = [len(c) for c in cells]
    del cells, twice, every, order, fresh, count, repeated
    give_back()
    return pd.DataFrame({"block": part["block"], "depth": part["depth"], "stretch": part["stretch"], "n": n, "bits": bits})


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The 128-bit digest of each window from a word `at`: of its words joined by single spaces, as two longs."""
    raw, bounds = joined(data, starts, ends)
    digest = xxhash.xxh3_128_digest
    out = b"".join([digest(raw[a:z]) for a, z in zip(bounds[at].tolist(), (bounds[at + length] - 1).tolist(), strict=True)])
    return np.frombuffer(out, dtype=np.int64).reshape(-1, 2)


def _candidates(blocks: DataFrame, n_bits: int, length: int) -> DataFrame:
    """(h1, h2, id, block, at) of every window that the sketch estimates repeated; at: row << 32 | word."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block, ids, bounds, texts, marks in _rows(b):
            data, starts, ends, first = _open(texts, bounds)
            at, rows = _windows(n_bits, first, HASH.words(data, starts, ends), length)
            picked = np.ones(len(at), dtype=bool)
            for d, cells in enumerate(rows):
                mine = sorted((m for m in marks if m["depth"] == d), key=lambda m: m["stretch"])
                bits = np.concatenate([np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"]) for m in mine]) if mine else np.empty(0, np.uint8)
                picked &= bits[np.unique(cells, return_inverse=True)[1]].astype(bool)
            del rows
            at = at[picked]
            if len(at):
                h = digests(data, starts, ends, at, length)
                row = np.searchsorted(first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()).take(pa.array(row)), pa.array(np.full(len(at), block)), pa.array((row << 32) | (at - first[row]))],
                    names=["h1", "h2", "id", "block", "at"],
                )

    return map_batches(blocks.select("block", "ids", "bounds", "texts", "marks"), run, "h1 long, h2 long, id long, block long, at long")


def _removals(blocks: DataFrame, rest_type: str, length: int, as_is: bool) -> DataFrame:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, (ids, bounds, texts, hits) in enumerate(_rows(b.select(["ids", "bounds", "texts", "hits"]))):
            data, starts, ends, first = _open(texts, bounds)
            gone = np.zeros(len(starts) + 1, dtype=np.int64)
            if hits:
                at = np.array(hits, dtype=np.int64)
                at = first[at >> 32] + (at & 0xFFFFFFFF)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + length, -1)
            stay = np.cumsum(gone)[:-1] == 0
            raw = data.tobytes()
            out, removed = [], np.diff(np.concatenate([[0], np.cumsum(~stay)])[first])
            for i in range(len(ids)):
                a, z = first[i], first[i + 1]
                text = raw[bounds[i] : bounds[i + 1]]
                if removed[i] or not as_is:
                    words = text.split()
                    text = b" ".join(itertools.compress(words, stay[a:z].tolist()) if removed[i] else words)
                out.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(first)), pa.array(removed), pa.array(out, pa.string()), b.column(4)[k].values],
                names=["id", "n_words", "n_removed", "text", "rest"],
            )

    return map_batches(blocks.select("ids", "bounds", "texts", "hits", "rest"), run, f"id long, n_words long, n_removed long, text string, rest {rest_type}")


def dedup(docs: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] = (), as_is: bool = False) -> DataFrame:
    """(id, n_words, n_removed, text, rest) for every document; text: the words that stay, joined by single spaces.

    rest: a struct c0, c1... of the columns in carry. as_is: a text that loses nothing stays as it is (a null one is empty).
    """
    blocks = _stage(docs, id_col, text_col, list(carry), length)
    total = blocks.agg(F.sum("windows")).first()[0] or 0
    n_bits = max(16, int(CELLS_PER_WINDOW * total - 1).bit_length()) if total else 16
    stretch_bits = min(n_bits, (CELLS_PER_WINDOW * STRETCH_WINDOWS).bit_length() - 1)
    marks = (
        _sketches(blocks, n_bits, stretch_bits, length)
        .groupBy("depth", "stretch")
        .applyInPandas(_merge, "block long, depth int, stretch long, n long, bits binary")
    )
    marks = cut(marks, "marks")
    per_block = marks.groupBy(F.col("block").alias("m_block")).agg(F.collect_list(F.struct("depth", "stretch", "n", "bits")).alias("marks"))
    found = cut(_candidates(blocks.join(per_block, F.col("block") == F.col("m_block")), n_bits, length), "candidates")
    drop_tables(marks)
    repeated = cut(found.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), "repeated")
    hits = cut(found.join(repeated, ["h1", "h2"]).where("id > lo").select("block", "at"), "hits")
    drop_tables(found, repeated)
    hits = hits.groupBy(F.col("block").alias("h_block")).agg(F.collect_list("at").alias("hits"))
    rest_type = blocks.schema["rest"].dataType.elementType.simpleString()
    return _removals(blocks.join(hits, F.col("block") == F.col("h_block"), "left"), rest_type, length, as_is)


def drop_repeats(docs: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated windows removed, all columns kept; texts that lose nothing stay as they are."""
    names = docs.columns
    # the blocks hold the texts already; of the column itself only whether it is null
    out = dedup(docs, length, id_col, text_col, [F.isnull(c).alias("none") if c == text_col else F.col(c) for c in names], as_is=True)
    columns = [F.col(f"rest.c{i}").alias(c) for i, c in enumerate(names)]
    at = names.index(text_col)
    columns[at] = F.when(~F.col(f"rest.c{at}"), F.col("text")).alias(text_col)
    if "n_chars" in names:
        i = names.index("n_chars")
        columns[i] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"rest.c{i}")).alias("n_chars")
    return out.select(columns)
