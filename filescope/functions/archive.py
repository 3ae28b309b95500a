"""ZIP directories and bounded inflation. Nothing is extracted to disk, and every expansion has a limit."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

# Limits of the directory scan.
EOCD_WINDOW, MAX_ENTRIES, ENTRY_LIMIT = 66_000, 2_000, 4_000_000


class Entry(NamedTuple):
    ordinal: int
    name: str
    compressed_size: int
    uncompressed_size: int
    method: int
    encrypted: bool
    data_start: int
    crc32: int


SCHEMA = "ordinal int, name string, compressed_size long, uncompressed_size long, method int, encrypted boolean, data_start long, crc32 long"


class ZipError(ValueError):
    """The directory of a ZIP file can't be read."""


def directory(data: bytes) -> list[Entry]:
    """The entries of a ZIP file, up to the first broken record."""
    return directory_of(lambda start, n: data[start : start + n], len(data))


def directory_of(read: Callable[[int, int], bytes], size: int, header: Callable[[int, int], bytes] | None = None, starts: bool = True) -> list[Entry]:
    """The entries of `size` bytes of which read(start, n) gives ranges: the end, the directory, and each entry's header.

    `header` reads the headers, which lie apart, if not `read` itself; without `starts` they are not read, and data_start is 0.
    """
    first = max(0, size - EOCD_WINDOW)
    tail = read(first, size - first)
    end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    if end < 0:
        raise ZipError("ZIP end-of-central-directory record not found")
    count, at = struct.unpack_from("<H", tail, end + 10)[0], struct.unpack_from("<I", tail, end + 16)[0]
    if at == 0xFFFFFFFF:
        raise ZipError("ZIP64 directories are not read")
    found: list[Entry] = []
    while len(found) < min(count, MAX_ENTRIES) and at + 46 <= size:
        record = read(at, 46)
        if record[:4] != b"PK\x01\x02":
            break
        flags, method, _, crc, packed, full, n_name, n_extra, n_comment, local = struct.unpack_from("<HHIIIIHHH8xI", record, 8)
        start = 0
        if starts and local + 30 <= size and (own := (header or read)(local, 30))[:4] == b"PK\x03\x04":
            start = local + 30 + sum(struct.unpack_from("<HH", own, 26))
        name = read(at + 46, n_name).decode("utf-8", "replace")
        found.append(Entry(len(found), name, packed, full, method, bool(flags & 1), start, crc))
        at += 46 + n_name + n_extra + n_comment
    return found


def inflate(data: bytes, raw: bool, limit: int = ENTRY_LIMIT) -> bytes | None:
    """At most `limit` bytes of a zlib or raw deflate stream; None if it is broken before that."""
    try:
        d = zlib.decompressobj(-15 if raw else 15)
        out = d.decompress(data, limit)
        return out if d.eof or len(out) >= limit else None
    except zlib.error:
        return None


def read(data: bytes, entry: Entry, limit: int = ENTRY_LIMIT) -> bytes | None:
    """An entry's bytes; None if it is encrypted, declared larger than `limit`, or of another method than 0 and 8."""
    if entry.encrypted or not entry.data_start or entry.uncompressed_size > limit:
        return None
    packed = data[entry.data_start : entry.data_start + entry.compressed_size]
    if entry.method == 0:
        return packed
    return inflate(packed, True, limit) if entry.method == 8 else None
