"""What PE files import and export: tables of a file's header, whose virtual addresses its sections' intervals place."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is read at most: sections, libraries, functions of a library, exported names, bytes of a name.
SECTIONS, LIBRARIES, FUNCTIONS, NAMES, NAME_BYTES = 96, 256, 4096, 4096, 256


class Section(NamedTuple):
    name: str
    address: int
    extent: int
    raw: int


class Image:
    """A PE file's sections and tables; ValueError or struct.error where there is no header."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        at = struct.unpack_from("<I", data, 0x3C)[0]
        if data[:2] != b"MZ" or data[at : at + 4] != b"PE\0\0":
            raise ValueError("no PE header")
        n, optional = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<H", data, at + 20)[0]
        self.wide = struct.unpack_from("<H", data, at + 24)[0] == 0x20B
        self.sections = []
        for base in range(at + 24 + optional, min(len(data) - 39, at + 24 + optional + 40 * min(n, SECTIONS)), 40):
            virtual, address, size, raw = struct.unpack_from("<IIII", data, base + 8)
            self.sections.append(Section(data[base : base + 8].split(b"\0")[0].decode("latin-1"), address, max(virtual, size), raw))
        first = 112 if self.wide else 96
        there = optional >= first + 16
        self.export_table, self.import_table = struct.unpack_from("<I4xI", data, at + 24 + first) if there else (0, 0)

    def place(self, address: int) -> int | None:
        """Where in the file a virtual address is: in the first section whose interval holds it."""
        own = next((s for s in self.sections if s.address <= address < s.address + s.extent), None)
        found = address - own.address + own.raw if own else len(self.data)
        return found if found < len(self.data) else None

    def text(self, address: int) -> str | None:
        at = self.place(address)
        return None if at is None else self.data[at : at + NAME_BYTES].split(b"\0")[0].decode("latin-1")

    def numbers(self, address: int, size: int, most: int) -> Iterator[int]:
        """Little-endian numbers from an address on, up to a zero or the end."""
        at = self.place(address)
        for i in range(most if at is not None else 0):
            raw = self.data[at + i * size : at + (i + 1) * size]
            value = int.from_bytes(raw, "little")
            if len(raw) < size or not value:
                return
            yield value

    def imports(self) -> Iterator[tuple[str | None, int, str | None]]:
        """(library, place, function) in the file's order: functions by name, or as #ordinal.

        Names come from the lookup table, or the bound one where there is none. Addresses beyond all sections give nulls.
        """
        at = self.place(self.import_table) if self.import_table else None
        size = 8 if self.wide else 4
        by_number = 1 << (8 * size - 1)
        for i in range(LIBRARIES if at is not None else 0):
            row = self.data[at + 20 * i : at + 20 * (i + 1)]
            if len(row) < 20 or not any(row):
                return
            lookup, _, _, name, bound = struct.unpack("<IIIII", row)
            library = self.text(name)
            for j, value in enumerate(self.numbers(lookup or bound, size, FUNCTIONS)):
                yield library, j, f"#{value & 0xFFFF}" if value & by_number else self.text((value & 0x7FFFFFFF) + 2)

    def exports(self) -> Iterator[tuple[int, str | None]]:
        """(place, name) of exported names, in their table's order."""
        at = self.place(self.export_table) if self.export_table else None
        if at is None or at + 40 > len(self.data):
            return
        count, table = struct.unpack_from("<I4xI", self.data, at + 24)
        for i, address in enumerate(self.numbers(table, 4, min(count, NAMES))):
            yield i, self.text(address)


def _image(content: bytes | None) -> Image | None:
    try:
        return Image(content or b"")
    except (ValueError, struct.error):
        return None


class Imports:
    """Table function of a file's bytes: a row per imported function; none for what is no PE file."""

    def eval(self, content: bytes):
        image = _image(content)
        yield from image.imports() if image else ()


class Exports:
    """Table function of a file's bytes: a row per exported name."""

    def eval(self, content: bytes):
        image = _image(content)
        yield from image.exports() if image else ()


def register(spark) -> None:
    """Make both known to SQL: `select ... from files, lateral pe_imports(content)`."""
    spark.udtf.register("pe_imports", F.udtf(Imports, returnType="library string, place int, function string"))
    spark.udtf.register("pe_exports", F.udtf(Exports, returnType="place int, name string"))


def _lateral(blobs: DataFrame, function: str, keys: tuple[str, ...]) -> DataFrame:
    spark = blobs.sparkSession
    register(spark)
    return spark.sql(f"select {', '.join((*keys, 'x.*'))} from {{blobs}}, lateral {function}(content) x", blobs=blobs.select(*keys, "content"))


def imports(blobs: DataFrame, *keys: str) -> DataFrame:
    """keys, library, place (from 0, in the file's order), function of blobs (content): a row per imported function."""
    return _lateral(blobs, "pe_imports", keys)


def exports(blobs: DataFrame, *keys: str) -> DataFrame:
    """keys, place, name: a row per exported name."""
    return _lateral(blobs, "pe_exports", keys)
