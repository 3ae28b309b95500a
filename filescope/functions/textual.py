"""Expressions on text: clamping, stripping markup, counting, inferring the types of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filescope.functions.names import trimmed
from filescope.functions.registry import MAX_TEXT


def clamp(text: Column, limit: int = MAX_TEXT) -> tuple[Column, Column]:
    """(text, truncated): without NULs, blanks before line ends and around, cut at `limit` characters."""
    plain = trimmed(F.regexp_replace(F.translate(text, "\0", ""), r"(?<![ \t])[ \t]+\n", "\n"))
    return F.substring(plain, 1, limit), F.length(plain) > limit


def strip_html(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    return F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"\s{2,}", " ")


def strip_rtf(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?i)\\'[0-9a-f]{2}", "")
    out = F.regexp_replace(out, r"(?i)\\[a-z]+-?\d*\s?", " ")
    return F.regexp_replace(F.regexp_replace(out, r"[{}]", " "), r"\s{2,}", " ")


def markup_stats(text: Column) -> dict[str, Column]:
    return {
        "title": F.nullif(trimmed(F.regexp_extract(text, r"(?i)<title[^>]*>([^<]{1,200})</title>", 1)), F.lit("")),
        "elements": F.regexp_count(text, F.lit(r"(?i)<([a-z][\w:-]*)")),
        "links": F.regexp_count(text, F.lit(r"(?i)href\s*=\s*[\x22\x27][^\x22\x27]+")),
    }


def text_stats(text: Column) -> dict[str, Column]:
    """Characters (UTF-16 units), lines, and words."""
    wide = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return {"characters": F.length(text) + wide, "lines": F.size(F.split(text, r"\r?\n", -1)), "words": F.regexp_count(text, F.lit(r"\S+"))}


def sql_stats(text: Column) -> dict[str, Column]:
    return {
        "statements": F.size(F.filter(F.split(text, ";", -1), lambda x: F.length(trimmed(x)) > 0)),
        "tables_created": F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\x22\x27`\w.]+"), 0), 1, 20), ", "),
    }


#: Date shapes that are taken for dates: ISO dates with or without times, M/D/Y, and names of months with a year.
DATE = r"(?i)\A\s*(\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?|\d{1,2}/\d{1,2}/\d{4}|((mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?\d{1,2} (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{4}( \d{2}:\d{2}(:\d{2})?( GMT)?)?)\s*\z"


def value_flags(value: Column) -> dict[str, Column]:
    """What a cell could be, blanks being anything."""
    v = trimmed(value)
    return {
        "blank": v == "",
        "integer": v.rlike(r"\A-?\d+\z"),
        "number": v.rlike(r"(?i)\A-?\d*\.?\d+(e[-+]?\d+)?\z"),
        "boolean": v.rlike(r"(?i)\A(true|false|yes|no)\z"),
        "date": v.rlike(DATE),
    }


def to_number(value: Column) -> Column:
    """A cell as JavaScript's Number makes it: blank is 0, hex and exponents count; null for what isn't finite."""
    v = trimmed(value)
    plain = F.when(v.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), v.try_cast("double"))
    hexed = F.when(v.rlike(r"\A0[xX][0-9a-fA-F]{1,13}\z"), F.conv(F.substring(v, 3, 16), 16, 10).cast("double"))
    found = F.when(v == "", 0.0).otherwise(F.coalesce(plain, hexed))
    return F.when(F.abs(found) < float("inf"), found)


def fixed(x: Column, digits: int) -> Column:
    """The exact value of a double rounded half up, away from zero, to some decimals, as JavaScript's toFixed does.

    x * 10^digits is taken with its rounding error (Dekker's product), so that ties are told from what is next to them.
    Beyond 2^53 hundredths (or what the digits make of it) a double has no such decimals.
    """
    size, scale = F.abs(x), float(10**digits)
    shifted = size * 134_217_729.0
    high = shifted - (shifted - size)
    product = size * scale
    error = (high * scale - product) + (size - high) * scale
    below = F.floor(product)
    part = product - below
    whole = below + F.when((part > 0.5) | ((part == 0.5) & (error >= 0)), 1).otherwise(0)
    text = F.lpad(whole.cast("string"), digits + 1, "0") if digits else whole.cast("string")
    text = F.when(F.length(whole.cast("string")) > digits + 1, whole.cast("string")).otherwise(text)
    shown = F.concat(text.substr(F.lit(1), F.length(text) - digits), F.lit("."), text.substr(F.length(text) - digits + 1, F.lit(digits))) if digits else text
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(product < float(1 << 53), shown).otherwise(F.format_string(f"%.{digits}f", size)))


def shortest(x: Column) -> Column:
    """A double without an exponent: whole ones have no fraction."""
    text = F.regexp_replace(x.cast("decimal(38,15)").cast("string"), r"0+\z", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e18), x.cast("decimal(22,0)").cast("string")).when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7), x.cast("string")).when(F.abs(x) < 1e18, text).otherwise(x.cast("string"))


def format_bytes(size: Column) -> Column:
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.format_string("%.1f KB", size / 1024.0)).otherwise(F.format_string("%.2f MB", size / 1048576.0))
