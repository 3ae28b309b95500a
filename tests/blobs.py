"""Byte fixtures: small files of many types, none of which is ever run."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def zipped(entries: dict[str, bytes], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def locked(data: bytes) -> bytes:
    """The same archive with all entries marked as encrypted in the directory."""
    out, at = bytearray(data), data.find(b"PK\x01\x02")
    while at >= 0:
        out[at + 8] |= 1
        at = data.find(b"PK\x01\x02", at + 4)
    return bytes(out)


def pe(machine: int = 0x8664) -> bytes:
    head = b"MZ" + bytes(58) + struct.pack("<I", 64)
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", machine, 1, 1_000_000_000, 0, 0, 0, 0x2000)
    section = b".text".ljust(8, b"\0") + struct.pack("<IIIIIIHHI", 4096, 0, 512, 0, 0, 0, 0, 0, 0x60000020)
    return head + coff + section + b"\0kernel32.dll\0VirtualAlloc\0WinExec\0"


def wav() -> bytes:
    return b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44_100, 176_400, 4, 16) + b"data\0\0\0\0" + bytes(176_400 * 2)


PDF = b"%PDF-1.4\n1 0 obj << /Title (A \\(b\\)) /Type /Page >> endobj\nBT (Hello) Tj [(Wo) (rld)] TJ ET\n/URI (http://a.example/x)\n"
PDF_FLATE = PDF + b"<< /Filter /FlateDecode /Length 9 >>\nstream\n" + zlib.compress(b"BT (inflated) Tj ET") + b"endstream\n"
PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)
DOCX = zipped({"[Content_Types].xml": b"<t/>", "word/document.xml": b'<w:p><w:pStyle w:val="Heading1"/><w:t>Title here</w:t></w:p><w:p ><w:t>Body &amp; more</w:t></w:p>', "docProps/core.xml": b"<dc:title>My doc</dc:title>"})
XLSX = zipped(
    {
        "xl/workbook.xml": b'<sheet name="One" r="x"/>',
        "xl/sharedStrings.xml": b"<si><t>Name</t></si><si><t>Ann</t></si>",
        "xl/worksheets/sheet1.xml": b'<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><f>1+1</f><v>2</v></c></row>',
    }
)
