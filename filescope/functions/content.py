"""Digests and byte statistics of contents."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from filescope.functions.lazy import arrow
from filescope.functions.registry import SAMPLE_BYTES, TEXT_SAMPLE


def header_hex(content: Column) -> Column:
    """The first 16 bytes in upper-case hex, separated by spaces."""
    return F.rtrim(F.regexp_replace(F.hex(F.substring(content, 1, 16)), "(..)", "$1 "))


def text(content: Column, n: int) -> Column:
    """The first n bytes as UTF-8, malformed ones replaced, without a byte-order mark."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, n).cast("string")), r"\A﻿", "")


def fixed(x: float, digits: int) -> str:
    """The exact value of a double rounded half up, as JavaScript's toFixed does below 1e21."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


_COUNTED = np.zeros(256, bool)
_COUNTED[[9, 10, 13, *range(32, 127)]] = True
_TEXTUAL = _COUNTED.copy()
_TEXTUAL[128:] = True


@arrow("entropy double, printable_ratio double, null_ratio double, textual boolean")
def byte_stats(contents: pd.Series) -> pd.DataFrame:
    """Entropy in bits a byte (3 decimals), shares of printable and of zero bytes, and whether it looks like text."""
    rows = []
    for data in contents:
        raw = np.frombuffer(data or b"", np.uint8)[:SAMPLE_BYTES]
        if not len(raw):
            rows.append((0.0, 0.0, 0.0, False))
            continue
        count = np.bincount(raw, minlength=256)
        p = count[count > 0] / len(raw)
        head = raw[:TEXT_SAMPLE]
        textual = bool(head.all() and _TEXTUAL[head].sum() / len(head) > 0.9)
        rows.append((float(fixed(float(-(p * np.log2(p)).sum()), 3)) + 0.0, float(count[_COUNTED].sum() / len(raw)), float(count[0] / len(raw)), textual))
    return pd.DataFrame(rows, columns=["entropy", "printable_ratio", "null_ratio", "textual"])


def with_hashes(blobs):
    """sha256, sha1 and md5 of `content`."""
    return blobs.withColumns({"sha256": F.sha2("content", 256), "sha1": F.sha1("content"), "md5": F.md5("content")})


def with_stats(blobs, **others):
    """entropy, printable_ratio, null_ratio, textual and header_hex of `content`; `others`: columns to add in the same step."""
    # Only what is counted goes to Python.
    s = blobs.withColumns({"_s": byte_stats(F.substring("content", 1, SAMPLE_BYTES))} | others)
    return s.withColumns({c: F.col(f"_s.{c}") for c in ("entropy", "printable_ratio", "null_ratio", "textual")} | {"header_hex": header_hex(F.col("content"))}).drop("_s")
