"""Result streams as JSON lines, written by the executors.

A first line with the number of rows, lines with chunks of rows, a last line. Each task writes its chunks to a file of its own
below a folder for unfinished work; the commit moves the files of the attempts that count beside a first and a last file
and deletes the rest. The driver sees names and counts only. Read the files of a folder in the order of their names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT, CHUNK = "tidemark_lines", 50_000


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), os.path.abspath(uri))


@dataclass
class Part(WriterCommitMessage):
    name: str
    order: int
    rows: int


class LineWriter(DataSourceArrowWriter):
    def __init__(self, path: str, chunk: int, overwrite: bool):
        self.path, self.chunk, self.overwrite, self.work = path.rstrip("/"), chunk, overwrite, f"_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, path = _filesystem(self.path)
        fs.create_dir(f"{path}/{self.work}", recursive=True)
        name, n, held = f"{uuid.uuid4().hex}.ndjson", 0, []
        with fs.open_output_stream(f"{path}/{self.work}/{name}") as out:
            for b in iterator:
                for row in b.column(0).to_pylist():
                    held.append(row)
                    n += 1
                    if len(held) == self.chunk:
                        out.write(self._line(held))
                        held = []
            if held:
                out.write(self._line(held))
        return Part(name, TaskContext.get().partitionId(), n)

    @staticmethod
    def _line(rows: list[str]) -> bytes:
        return ('{"type": "data", "data": [' + ", ".join(rows) + "]}\n").encode()

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = _filesystem(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.order)
        if self.overwrite:
            for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
                if f.type == pa.fs.FileType.File:
                    fs.delete_file(f.path)
        fs.create_dir(path, recursive=True)
        for m in parts:
            if m.rows:
                fs.move(f"{path}/{self.work}/{m.name}", f"{path}/part-{m.order:08d}.ndjson")
        for name, line in (("first", {"type": "meta", "total_rows": sum(m.rows for m in parts)}), ("zlast", {"type": "complete", "success": True})):
            with fs.open_output_stream(f"{path}/{name}.ndjson") as out:
                out.write((json.dumps(line) + "\n").encode())
        self._clean()

    def abort(self, messages: list[Part | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, path = _filesystem(self.path)
        if fs.get_file_info(f"{path}/{self.work}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.work}")


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], int(self.options.get("chunk", CHUNK)), overwrite)


def write_lines(df: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Replace the files at path by the rows of df; numbers that JSON doesn't have become null."""
    df.sparkSession.dataSource.register(Lines)
    cells = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("row")).write.format(FORMAT).mode("overwrite").option("chunk", chunk).save(path)


def read_lines(path: str) -> Iterator[dict]:
    """The lines of a folder in order, for a client."""
    fs, at = _filesystem(path)
    for f in sorted(fs.get_file_info(pa.fs.FileSelector(at)), key=lambda f: f.path):
        if f.type == pa.fs.FileType.File and f.path.endswith(".ndjson"):
            with fs.open_input_stream(f.path) as file:
                yield from (json.loads(line) for line in file.read().decode().splitlines())
