"""What PDF files show, by a scan of their bytes that takes time in proportion to them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from filescope.functions import archive

#: A string with the operator after it, an array's start, its end with the operator after it.
_SCAN = re.compile(rb"\(((?:[^\\()]|\\.)*+)\)\s*+(Tj|')?|(\[)|(\])\s*+(TJ)?", re.S)
_ESCAPED = re.compile(r"\\([nrtbf()\\])")
# What escapes of one letter stand for.
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "b": "", "f": ""}
_FLATE = re.compile(rb"/Filter\s*+/FlateDecode")
_STREAM = re.compile(rb">>\s*+stream\r?\n")


def string(raw: bytes) -> str:
    """The characters of a literal string."""
    return _ESCAPED.sub(lambda m: _LETTERS.get(m[1], m[1]), raw.decode("latin-1"))


def shown(stream: bytes) -> str:
    """The strings that text operators show: a line for Tj and TJ each, a blank after those of the quote operator."""
    out: list[str] = []
    array: list[bytes] | None = None
    mark = 0
    for m in _SCAN.finditer(stream):
        text, operator, opens, closes, joined = m.groups()
        if text is None and not joined and array is not None and stream[m.start() - 1 : m.start()] == b"\\":
            continue  # an escaped bracket in an array
        if text is not None:
            if array is not None:
                array.append(text)
            if operator:
                out += [string(text), " " if operator == b"'" else "\n"]
        elif opens:
            array, mark = [], len(out)
        elif closes:
            if joined and array is not None:
                del out[mark:]
                out += [*map(string, array), "\n"]
            array = None
    return "".join(out)


def streams(data: bytes) -> Iterator[bytes]:
    """The inflated Flate streams, one after the other; those that are broken are left out."""
    at = 0
    while m := _FLATE.search(data, at):
        at = data.find(b">", m.end())
        if at < 0:
            return
        begins = _STREAM.match(data, at)
        if not begins:
            continue
        at = data.find(b"endstream", begins.end())
        if at < 0:
            return
        part = data[begins.end() : at]
        plain = archive.inflate(part, False) or archive.inflate(part, True)
        if plain:
            yield plain
