"""Shards in a store that isn't the local file system."""

import hashlib

import pyarrow as pa
import pyarrow.fs

from tidemark.llm import media


def test_write_and_read_back_by_uri(monkeypatch):
    """Both sides open a shard through the file system that its whole URI names."""
    held, asked = pa.fs._MockFileSystem(), []

    def filesystem(uri):
        asked.append(uri)
        assert uri.startswith("s3://bucket/dir/")
        return held, uri.removeprefix("s3://")

    monkeypatch.setattr(media, "filesystem", filesystem)
    held.create_dir("bucket/dir", recursive=True)
    payloads = [bytes([i]) * 192 * (i + 1) for i in range(5)]
    batches = [pa.RecordBatch.from_pydict({"payload": payloads[:3]}), pa.RecordBatch.from_pydict({"payload": payloads[2:] + payloads[:1]})]
    rows = []
    for name, part in (("a", batches), ("b", batches[:1])):
        rows += [r | {"size": r["length"]} for b in media.write_shard(iter(part), f"s3://bucket/dir/{name}.tar") for r in b.to_pylist()]
    assert [r["digest"] for r in rows] == [hashlib.sha256(p).hexdigest() for p in payloads + payloads[:3]]
    opened = {}
    got = media.read_ranges(rows, opened)
    assert [media.from_png(x) for x in got] == payloads + payloads[:3]
    assert list(opened) == ["s3://bucket/dir/b.tar"] and asked == [f"s3://bucket/dir/{n}.tar" for n in "abab"]
    media.close(opened)
    assert not opened
