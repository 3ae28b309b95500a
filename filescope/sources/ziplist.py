"""A data source of the entries of ZIP files, which reads ranges: the end of a file, its directory, and no bodies.

    spark.dataSource.register(ZipDirectories)
    spark.read.format("zip_directory").option("pathGlobFilter", "*.zip").load("s3://bucket/archives")

The driver lists the files and plans partitions of some of them each; tasks seek in their files. Paths are those of
pyarrow.fs: local ones, and URIs of the stores that it knows.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filescope.functions import archive

SCHEMA = f"path string, file_size long, bytes_read long, {archive.SCHEMA}, error string"
#: Bytes that a read of the directory asks for at least.
AHEAD = 16_384


class Listed(NamedTuple):
    path: str
    size: int


class Files(InputPartition):
    def __init__(self, files: list[Listed]) -> None:
        super().__init__(None)
        self.files = files


class Ranges:
    """Ranges of an open file; what the last read brought beyond its range serves the next ones."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.held, self.total = file, size, 0, b"", 0

    def exactly(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        got = self.file.read(n)
        self.total += len(got)
        return got

    def __call__(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.held)):
            self.held, self.at = self.exactly(start, min(max(n, AHEAD), self.size - start)), start
        return self.held[start - self.at : start - self.at + n]


def entries(file, size: int, starts: bool) -> tuple[list[archive.Entry], str | None, int]:
    """(entries, error, bytes read) of an open file."""
    ranges = Ranges(file, size)
    try:
        return archive.directory_of(ranges, size, ranges.exactly, starts), None, ranges.total
    except (archive.ZipError, ValueError, IndexError, struct.error) as e:
        return [], str(e), ranges.total


class ZipReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, each: int, starts: bool) -> None:
        self.path, self.pattern, self.each, self.starts = path, pattern, each, starts

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._system()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(Listed(f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern))
        return [Files(files[i : i + self.each]) for i in range(0, len(files), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for f in partition.files:
            with system.open_input_file(f.path) as file:
                found, error, total = entries(file, f.size, self.starts)
            for e in found:
                yield f.path, f.size, total, *e, None
            if error is not None:
                yield f.path, f.size, total, *[None] * len(archive.Entry._fields), error


class ZipDirectories(DataSource):
    """Options: path; pathGlobFilter (*); filesPerPartition (64); dataStart (false: entries' headers are not read).

    A row per entry, in the directory's order, at most MAX_ENTRIES of a file; one with an error for a file without a
    directory, none for one whose directory is empty. bytes_read is what was read of the file in all.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        o = self.options
        if "path" not in o:
            raise ValueError("zip_directory needs a path")
        each = int(o.get("filesPerPartition", 64))
        if each < 1:
            raise ValueError("filesPerPartition is at least 1")
        path = o["path"]
        return ZipReader(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1), o.get("pathGlobFilter", "*"), each, o.get("dataStart", "false").lower() == "true")


def save(blobs, path: str):
    """Write each blob (blob_id, content) as a file of its own, `path`/<blob_id>.zip; gives how many. A retry writes the same."""
    import pyarrow as pa
    from pyarrow import fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for ident, data in zip(batch.column("blob_id").to_pylist(), batch.column("content"), strict=True):
                with system.open_output_stream(f"{root}/{ident}.zip") as out:
                    out.write(data.as_buffer() if data.is_valid else b"")
            yield pa.RecordBatch.from_arrays([batch.column("blob_id")], names=["blob_id"])

    return blobs.select("blob_id", "content").mapInArrow(write, "blob_id long").count()
