"""Media columns: content-addressed payloads in tar shards.

A text's payload is its UTF-8 bytes, filled with spaces to a positive multiple of 192, stored as a grey
8-bit PNG of 192 samples a row. Payloads are named by their SHA-256. Each task streams one tar shard into
the shared folder, under a name of its own for every attempt, in which equal payloads are stored once; its
rows say where each payload is, and only the rows of attempts that Spark commits count, so a shard that a lost
executor leaves behind is never referred to. The manifest has one place for each digest; a payload that
several tasks met lies in the shard of each, which costs less than to shuffle all payloads by digest.

Rows carry (digest, shard, offset, length). Metadata columns are filled by reading the 33 bytes of a PNG's
signature and header at the offset; payloads are read back by ranges as well.

Defined results: a null or empty text has one row of 192 spaces; equal texts have equal values; texts of
any length are stored whole; repeated rows each have their row; a null id stays null.
"""

from __future__ import annotations

import hashlib
import math
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, filesystem, fresh_path, texts

#: Stored bytes that one task reads back at most.
TASK_BYTES = 64 << 20
#: Samples a row: payloads are multiples of this.
ROW = 192
LEVEL = 6
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)  # each row after its filter type, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(raw: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, colour type) from the first 33 bytes."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR" or zlib.crc32(raw[12:29]) != struct.unpack(">I", raw[29:33])[0]:
        raise ValueError("no PNG header here")
    return struct.unpack(">IIBB", raw[16:26])


def from_png(raw: bytes) -> bytes:
    width, height, _, _ = png_header(raw)
    at, body = 8, []
    while at < len(raw):
        n = struct.unpack(">I", raw[at : at + 4])[0]
        if raw[at + 4 : at + 8] == b"IDAT":
            body.append(raw[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only rows without a filter are written here")
    return lines[:, 1:].tobytes()


def padded(text: Column) -> Column:
    """The payload of a text."""
    raw = text.cast("binary")
    size = (F.greatest(F.ceil(F.octet_length(text) / ROW), F.lit(1)) * ROW).cast("int")
    return F.rpad(raw, size, F.unhex(F.lit("20")))


def write_shard(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """Write payloads as one tar file, wherever the URI says: (digest, shard, offset, length) of each different one."""
    out, at, seen = None, 0, set()
    for b in batches:
        rows = []
        for payload in b.column(0).to_pylist():
            digest = hashlib.sha256(payload).digest()
            if digest in seen:
                continue
            seen.add(digest)
            if out is None:
                fs, path = filesystem(uri)
                out = fs.open_output_stream(path)
            media = to_png(payload)
            info = tarfile.TarInfo(digest.hex() + ".png")
            info.size = len(media)
            head = info.tobuf(tarfile.GNU_FORMAT)
            rest = -len(media) % tarfile.BLOCKSIZE
            out.write(head + media + bytes(rest))
            rows.append((digest.hex(), uri, at + len(head), len(media)))
            at += len(head) + len(media) + rest
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["digest", "shard", "offset", "length"])
    if out is not None:
        out.write(bytes(2 * tarfile.BLOCKSIZE))
        out.close()


def read_ranges(rows: list[dict], opened: dict) -> list[bytes]:
    """The bytes of each row (shard, offset, size); opened keeps the last shard's file open for the next call."""
    out = []
    for r in rows:
        if r["shard"] not in opened:
            close(opened)
            fs, path = filesystem(r["shard"])
            opened[r["shard"]] = fs.open_input_file(path)
        out.append(opened[r["shard"]].read_at(r["size"], r["offset"]))
    return out


def close(opened: dict) -> None:
    for file in opened.values():
        file.close()
    opened.clear()


def store(docs: DataFrame, root: str | None = None, text_col: str = "text") -> DataFrame:
    """Write the payloads of all texts as tar shards below root; the manifest (digest, shard, offset, length).

    root: a folder that all executors share; a fresh one in the shared folder if not given.
    """
    spark = docs.sparkSession
    root = (root or fresh_path(spark, "media")).rstrip("/")
    fs, path = filesystem(root)
    fs.create_dir(path, recursive=True)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return write_shard(batches, f"{root}/shard-{uuid.uuid4().hex}.tar")

    bounded_batches(spark)
    payloads = docs.select(padded(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("payload"))
    written = cut(payloads.mapInArrow(shards, "digest string, shard string, offset long, length long"), "written")
    place = F.min(F.struct("shard", "offset", "length")).alias("_p")
    size = written.agg(F.sum("length")).first()[0] or 0
    one = written.groupBy("digest").agg(place).select("digest", "_p.*")
    return cut(one.repartitionByRange(max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES)), "shard", "offset").sortWithinPartitions("shard", "offset"), "manifest")


def _read(manifest: DataFrame, size: Column, make, schema: str) -> DataFrame:
    """make(list of bytes) -> columns, for the first `size` bytes of every payload, read by ranges.

    The manifest's rows come in the order of shards and offsets: a task opens a shard once and reads ahead in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            rows = b.to_pylist()
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                yield pa.RecordBatch.from_pydict({"digest": [r["digest"] for r in part], **make(read_ranges(part, opened))})
        close(opened)

    bounded_batches(manifest.sparkSession)
    return manifest.select("digest", "shard", "offset", size.alias("size")).mapInArrow(run, f"digest string, {schema}")


def headers(manifest: DataFrame) -> DataFrame:
    """(digest, width, height, bits) from header-only reads."""

    def make(raw):
        found = [png_header(x) for x in raw]
        return {"width": pa.array([f[0] for f in found], pa.int64()), "height": pa.array([f[1] for f in found], pa.int64()), "bits": pa.array([f[2] for f in found], pa.int32())}

    return _read(manifest, F.lit(HEADER), make, "width long, height long, bits int")


def feature(payload: bytes) -> str:
    """An average hash: which of 64 equal stretches of the samples lie above the mean of all, and that mean."""
    x = np.frombuffer(payload, np.uint8)
    sums = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64)
    counts = np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    above = sums * len(x) > counts * sums.sum()
    return f"{int.from_bytes(np.packbits(above).tobytes(), 'big'):016x}:{int(sums.sum()) / len(x):.3f}"


def features(manifest: DataFrame) -> DataFrame:
    """(digest, payload_sha256, tail_crc32, media_sha256, feature) from the stored bytes."""

    def make(raw):
        payloads = [from_png(x) for x in raw]
        return {
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
            "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
            "media_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
            "feature": [feature(p) for p in payloads],
        }

    return _read(manifest, F.col("length"), make, "payload_sha256 string, tail_crc32 long, payload_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: where its payload is, what its header says and what its bytes give."""
    manifest = store(docs, root, text_col)
    known = cut(manifest.join(headers(manifest), "digest").join(features(manifest), "digest"), "media")
    rows = texts(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(padded(F.col("text")), 256).alias("digest"))
    return rows.join(known, "digest")
