"""What the operators share: tables in the shared folder, and words hashed with numpy.

Every operator selects only its key and text columns before it works, so extra columns,
whatever their names, are neither read nor in the way.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the control characters 9 to 13.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Arrow batches hold at most this many bytes (a longer text makes a batch alone).
BATCH_BYTES = 4 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session has it.

    Where it is unset, a temporary folder is made and set for a local master; a cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders made by this driver and not yet deleted.
_made: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.discard(folder)


def clear(spark: SparkSession) -> None:
    """Delete all that the operators wrote to the shared folder; results that weren't saved elsewhere go with it."""
    for folder in list(_made):
        _delete(spark, folder)


#: For tables with rows of some MB: sizes are looked at after each row, not after 100 rows, and a row group, which readers hold as a whole, has few of them.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a DataFrame as a table in the shared folder and read it back: lineage ends here.

    The shuffle files of the write are released as soon as it ends, for the table replaces them.
    options: of the writer.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for t in tables:
        for d in {f.rpartition("/")[0] for f in t.inputFiles()}:
            name = d.rpartition("/")[2]
            _delete(t.sparkSession, next((m for m in _made if m.endswith("/" + name)), d))


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by bytes, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), a null text being empty; nothing else is read."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return to the system what this process has freed. A worker serves many tasks and would keep the peaks of all of them."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one call per non-empty batch, after each of which the worker gives back what it freed."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
                del b, out
                give_back()

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id, as decimal text, leaves 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """A pyarrow file system and path for a folder in the shared store (file, hdfs, s3, gs...)."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), os.path.abspath(uri))


# --- words as numpy arrays -------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=_U)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * _U(step & (2**64 - 1))
        have, step = have + take, step * step % 2**64
    return out


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of words that don't overlap, without what lies between, and each word's bounds in them (words + 1)."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return data[np.cumsum(edge[:-1], dtype=np.int8) > 0], np.concatenate([[0], np.cumsum(ends - starts)])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The words' bytes, a space after each, and where each word starts there (words + 1)."""
    items, bounds = packed(data, starts, ends)
    bounds = bounds + np.arange(len(bounds))
    out, ink = np.full(bounds[-1], 32, dtype=np.uint8), np.ones(bounds[-1], dtype=bool)
    ink[bounds[1:] - 1] = False
    out[ink] = items
    return memoryview(out.tobytes()), bounds


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each word data[start:end] the number of its distinct word, and these as bytes; words are compared whole."""
    items, bounds = packed(data, starts, ends)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds * data.itemsize), pa.py_buffer(np.ascontiguousarray(items))])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


class Hasher:
    """64-bit hashes of words (XXH3 of their bytes), and of runs of words by a polynomial modulo 2**64.

    Prefix sums of hash * base**position make the hash of any run two look-ups and one product. Runs with much
    symmetry in them can meet in one hash, so it only selects: what decides compares the words or a digest of them.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.seed, self.run_base = seed, int(rng.integers(2**40, 2**62)) * 8 + 5
        self._up, self._down = {}, {}

    def _tables(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up.get(base, ())) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            self._up[base], self._down[base] = _powers(base, size), _powers(pow(base, -1, 2**64), size)
        return self._up[base], self._down[base]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each word data[start:end]."""
        if not len(starts):
            return np.empty(0, dtype=_U)
        which, words = distinct(data, starts, ends)
        digest, seed = xxhash.xxh3_64_intdigest, self.seed
        return np.fromiter((digest(w, seed) for w in words), dtype=_U, count=len(words))[which]

    def runs(self, words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """A hash for each run of so many words from a start."""
        if not len(starts):
            return np.empty(0, dtype=_U)
        up, down = self._tables(self.run_base, len(words))
        total = np.zeros(len(words) + 1, dtype=_U)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix((total[starts + length] - total[starts]) * down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a whole string column, and each row's bounds in them (rows + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and the first word's number for each row (rows + 1).

    between: of each of the 256 bytes whether it separates words.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    ink = ~between[data]
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    edge = bounds[:-1][bounds[:-1] < bounds[1:]]  # rows follow one another without a separator
    starts[edge] = ink[edge]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    ends[last] = ink[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, bounds)


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the words at which a run of so many words of one row starts."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[:-1] - (ends - counts), counts)
