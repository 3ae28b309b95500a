"""File names: cleaning, extensions, and whether an extension agrees with a type. All of it is Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filescope.functions.registry import ALIASES, EXECUTABLE, EXTENSION_MAP

#: White space as JavaScript's trim knows it; Spark's trim takes spaces only.
SPACE = r"[\s\x0B   -     　﻿]"

#: A character that trimming leaves.
FILLED = f"[^{SPACE[1:]}"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def _base(name: Column) -> Column:
    return F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)


def sanitize(name: Column) -> Column:
    """The last path segment without control characters, at most 255 characters; `file` if nothing is left."""
    clean = F.regexp_replace(_base(name), r"[\x00-\x1F\x7F]", "").substr(1, 255)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("file"))


def extension(name: Column) -> Column:
    """The lower-case extension; null without a dot that has something before and after it."""
    return F.nullif(F.lower(F.regexp_extract(_base(trimmed(name)), r"\A[\s\S]+\.([^.]+)\z", 1)), F.lit(""))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def expected_type(ext: Column) -> Column:
    return F.try_element_at(_literal_map(EXTENSION_MAP), ext)


def extension_match(ext: Column, kind: Column, own: Column) -> Column:
    """Null without an extension; else whether it stands for the type, or is one that the type accepts."""
    accepted = F.coalesce(F.split(F.try_element_at(_literal_map(ALIASES), kind), " "), F.array(own))
    return F.when(ext.isNotNull(), F.coalesce(expected_type(ext) == kind, F.lit(False)) | F.array_contains(accepted, ext))


def recommended_extension(match: Column, own: Column) -> Column:
    return F.when(F.coalesce(match, F.lit(False)), None).otherwise(F.nullif(own, F.lit("")))


def is_executable(ext: Column) -> Column:
    return F.coalesce(ext.isin(EXECUTABLE), F.lit(False))
