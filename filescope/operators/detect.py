"""Type detection: signatures, what containers hold, then the structure of text.

Signatures, text probes and delimiters are Catalyst expressions over the content's first bytes. Python is used, in
Arrow batches, for what Catalyst has no exact function for: byte statistics, strict JSON and ZIP directories.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescope.functions import archive, content, names
from filescope.functions.lazy import arrow, once
from filescope.functions.registry import CONTAINER_TYPES, OLE_BYTES, PROBE_BYTES, TEXT_TYPES, Signature, confidence_of, ranked_signatures


def matches(data: Column, s: Signature) -> Column:
    """Whether the pattern is at its offset; wildcards split it into runs of bytes."""
    tests, at = [], 0
    for part in s.pattern.split("??"):
        n = len(part) // 2
        if n:
            tests.append(F.substring(data, s.offset + at + 1, n) == F.lit(bytes.fromhex(part)))
        at += n + 1
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def signature_index(data: Column) -> Column:
    """The place in ranked_signatures() of the first that matches; null if none does."""
    return F.coalesce(*(F.when(matches(data, s), F.lit(i)) for i, s in enumerate(ranked_signatures())))


def little_endian(data: Column, start: int, size: int) -> Column:
    """An unsigned little-endian number at `start` (from 0); null beyond the end."""
    hexes = [F.hex(F.substring(data, start + i + 1, 1)) for i in reversed(range(size))]
    return F.when(F.length(data) >= start + size, F.conv(F.concat(*hexes), 16, 10).cast("long"))


def is_pe(data: Column) -> Column:
    """Whether the MZ stub's pointer leads to a PE header."""
    at = F.when(F.length(data) > 64, little_endian(data, 60, 4)).otherwise(F.lit(0))
    near = at + 4 < F.length(data)
    return near & (F.substring(data, F.when(near, at + 1).otherwise(F.lit(1)).cast("int"), F.lit(2)) == F.lit(b"PE"))


def _strict(text: str) -> bool:
    def refuse(name: str):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except (ValueError, RecursionError):
        return False


_TRIM = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


@arrow("string")
def json_kind(texts: pd.Series) -> pd.Series:
    """json, jsonl or null: the whole text is one value in brackets, or its first five lines are a value each."""

    def kind(text: str | None) -> str | None:
        own = (text or "").strip(_TRIM)
        if own[:1] in ("[", "{") and _strict(own):
            return "json"
        lines = [x for x in own.replace("\r\n", "\n").split("\n") if x][:5]
        return "jsonl" if len(lines) > 1 and all(map(_strict, lines)) else None

    return texts.map(kind)


@arrow(f"kind string, n_entries int, error string, entries array<struct<{archive.SCHEMA.replace(' ', ':').replace(',:', ',')}>>, rels string")
def zip_scan(contents: pd.Series) -> pd.DataFrame:
    """What a ZIP container is, its entries, and its first relationships part; error instead where there is no directory."""
    mimes = [("odt", b"opendocument.text"), ("ods", b"opendocument.spreadsheet"), ("odp", b"opendocument.presentation"), ("epub", b"epub")]

    def kind(data: bytes, found: list[archive.Entry]) -> str:
        own = [e.name for e in found]
        mime = next((e for e in found if e.name == "mimetype"), None)
        if mime and mime.compressed_size < 200:
            raw = data[mime.data_start : mime.data_start + mime.compressed_size]
            for name, mark in mimes:
                if mark in raw:
                    return name
        for name, prefix in (("docx", "word/"), ("xlsx", "xl/"), ("pptx", "ppt/")):
            if any(n.startswith(prefix) for n in own):
                return name
        if "AndroidManifest.xml" in own and any(n.endswith(".dex") for n in own):
            return "apk"
        return "jar" if any(n.startswith("META-INF/") for n in own) and any(n.endswith(".class") for n in own) else "zip"

    def scan(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None
        try:
            found = archive.directory(data)
        except (archive.ZipError, ValueError, IndexError) as e:
            return "zip", 0, str(e), None, None
        rel = next((e for e in found if e.name.endswith(".rels")), None)
        part = archive.read(data, rel, 1_000_000) if rel else None
        return kind(data, found), len(found), None, [e._asdict() for e in found], None if part is None else part.decode("utf-8", "replace")

    return pd.DataFrame([scan(x) for x in contents], columns=["kind", "n_entries", "error", "entries", "rels"])


def text_kind(text: Column, json_like: Column) -> Column:
    """The first text probe that matches, as a key of TEXT_TYPES with its confidence; null if none does."""
    has = text.rlike
    # [a](b): what follows the first bracket pair with a parenthesis is searched for the closing one, all in linear time.
    linked = F.contains(F.regexp_extract(text, r"(?:\A|\])[^\[\]]*+\[[^\]]++\]\([^)]([\s\S]*)", 1), F.lit(")"))
    probes = [
        (has(r"(?i)\A\s*<\?xml") & has(r"(?i)<svg[\s>]"), "svg", 96),
        (has(r"(?i)\A\s*<svg[\s>]"), "svg", 95),
        (has(r"(?i)\A\s*<!doctype html|\A\s*<html[\s>]"), "html", 94),
        (has(r"(?i)\A\s*<\?xml"), "xml", 93),
        (json_like == "json", "json", 98),
        (json_like == "jsonl", "jsonl", 90),
        (has(r"(?i)\A\s*+(?:(?:--|/\*)\s*+)?(select|insert|update|delete|create\s+table|drop\s+table|alter\s+table)\b"), "sql", 80),
        (has(r"\A#!\s*/") | has(r"(?m)^[ \t\x0B\f]*(import |from |def |function |const |package |#include)"), "script", 70),
        (has(r"\A\s*(#|---)") & has(r"(?m)^[\w.\x22\x27-]+\s*:\s*\S"), "yaml", 72),
        (has(r"\A\s{0,3}#{1,6}\s|\n\s{0,3}#{1,6}\s") | linked, "markdown", 70),
    ]
    return F.coalesce(*(F.when(p, F.struct(F.lit(k).alias("kind"), F.lit(float(c)).alias("confidence"))) for p, k, c in probes))


def first_lines(text: Column) -> Column:
    """The first 20 lines that are not blank."""
    return F.slice(F.filter(F.split(text, r"\r?\n", -1), lambda x: x.rlike(names.FILLED)), 1, 20)


def delimiter(lines: Column) -> Column:
    """(kind, columns, lines) of a text by its first_lines(), where they have equally many of a delimiter, one at least.

    It reads `lines` many times, so it should be a column that is there.
    """

    def found(mark: str, kind: str) -> Column:
        counts = F.array_distinct(F.transform(lines, lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(mark), F.lit("")))))
        same = (F.size(lines) >= 2) & (F.size(counts) == 1) & (F.get(counts, F.lit(0)) >= 1)
        return F.when(same, F.struct(F.lit(kind).alias("kind"), (F.get(counts, F.lit(0)) + 1).alias("columns"), F.size(lines).alias("lines")))

    return F.coalesce(found(",", "csv"), found("\t", "tsv"), found(";", "ssv"))


def ole_kind(data: Column) -> Column:
    own = F.translate(content.text(data, OLE_BYTES), "\0", "")
    return F.when(own.rlike("(?i)Workbook|Microsoft Excel"), "xls").when(own.rlike("(?i)PowerPoint Document"), "ppt").when(own.rlike("(?i)WordDocument"), "doc").otherwise("ole")


_FIELDS = "key string, type string, label string, mime string, category string, extension string, confidence double, proof array<string>, container string"


def registry_rows() -> list[tuple]:
    """All that a file can turn out to be, by key: what its detection says, and the evidence that doesn't vary."""
    rows = []
    for i, s in enumerate(ranked_signatures()):
        pattern = " ".join(s.pattern[j : j + 2] for j in range(0, len(s.pattern), 2))
        magic = f"Magic bytes matched at offset {s.offset}: {pattern}"
        own = (s.type, s.label, s.mime, s.category, s.extension)
        if s.type == "zip":
            rows += [(f"{i}:{t[0]}", *t[:5], float(t[5]), [magic, None, t[6]], "zip") for t in CONTAINER_TYPES[:10]]
        elif s.type == "ole":
            rows += [(f"{i}:{t[0]}", *t[:5], float(t[5]), [magic, "OLE2 compound-file header (D0 CF 11 E0)", t[6]], "ole2") for t in CONTAINER_TYPES[10:]]
        elif s.type == "mp4":
            rows += [(f"{i}:heic", "heic", "HEIC Image", "image/heic", "image", "heic", 96.0, [magic, None], "iso-bmff"), (f"{i}:mp4", *own, 96.0, [magic, None], "iso-bmff")]
        elif s.type == "pe":
            rows += [(f"{i}:pe", "pe", "Windows Executable / Library (PE)", *own[2:], 99.0, [magic, None], None), (f"{i}:mz", "pe", "DOS MZ Executable", *own[2:], 75.0, [magic, "PE header not found after MZ stub"], None)]
        else:
            rows.append((str(i), *own, confidence_of(s), [magic], None))
    for kind, confidence in TEXT_CONFIDENCE:
        proof = {"txt": "No binary signature; content is predominantly printable text", "csv": None, "tsv": None, "ssv": None}.get(kind, "Textual content matched a structural pattern")
        rows.append((f"{kind}:{confidence}", *TEXT_TYPES[kind], float(confidence), [proof], None))
    rows.append(("unknown", "unknown", "Unknown / Unrecognised Binary", "application/octet-stream", "unknown", None, 5.0, ["No magic-byte signature matched", "Content is not valid printable text", None], None))
    return rows


#: Columns beside the detection that other operators read.
KEPT = ("entropy", "printable_ratio", "null_ratio", "textual", "header_hex", "zip")
TEXT_CONFIDENCE = [("svg", 96), ("svg", 95), ("html", 94), ("xml", 93), ("json", 98), ("jsonl", 90), ("sql", 80), ("script", 70), ("yaml", 72), ("markdown", 70), ("csv", 88), ("tsv", 88), ("ssv", 88), ("txt", 70)]


@once
def _expressions() -> dict[str, Column]:
    """The columns that with_detection() adds, each of which may use those before it."""
    data, own_text = F.col("content"), F.col("_text")
    kinds = [s.type for s in ranked_signatures()]
    at = lambda kind: F.col("_sig").isin([i for i, k in enumerate(kinds) if k == kind])
    brand = F.substring(data, 9, 4).cast("string")
    inner = (
        F.when(at("zip"), F.col("zip.kind"))
        .when(at("ole"), ole_kind(data))
        .when(at("mp4"), F.when(brand.rlike("heic|heif|mif1"), "heic").otherwise("mp4"))
        .when(at("pe"), F.when(is_pe(data), "pe").otherwise("mz"))
    )
    key = (
        F.when(F.col("_sig").isNotNull(), F.concat_ws(":", F.col("_sig").cast("string"), inner))
        .when(F.col("_probe").isNotNull(), F.concat(F.col("_probe.kind"), F.lit(":"), F.col("_probe.confidence").cast("int").cast("string")))
        .when(F.col("_delimited").isNotNull(), F.concat(F.col("_delimited.kind"), F.lit(":88")))
        .when(F.col("_text").isNotNull(), "txt:70")
        .otherwise("unknown")
    )
    text = lambda x: x.cast("string")
    varying = (
        F.when(at("zip"), F.concat(F.lit("ZIP container with "), text(F.coalesce("zip.n_entries", F.lit(0))), F.lit(" entries")))
        .when(at("mp4"), F.concat(F.lit("ftyp brand: "), F.make_valid_utf8(brand)))
        .when(at("pe"), F.concat(F.lit("PE signature located at 0x"), F.lower(F.hex(F.coalesce(little_endian(data, 60, 4), F.lit(0))))))
        .when(F.col("_delimited").isNotNull(), F.concat(F.lit("Consistent "), text(F.col("_delimited.columns")), F.lit("-column delimited structure across "), text(F.col("_delimited.lines")), F.lit(" sampled lines")))
    )
    expected = names.expected_type(F.col("_ext"))
    unknown = F.col("_key") == "unknown"
    suggestion = F.when(expected.isNotNull(), F.concat(F.lit('Filename extension suggests "'), expected, F.lit('" but content does not confirm it'))).otherwise("No usable filename extension")
    gap = F.when(unknown, suggestion).otherwise(F.col("_varying"))
    detection = F.struct(
        "type", "label", "mime", "category",
        F.coalesce("extension", "_ext", F.lit("")).alias("extension"),
        F.when(unknown & expected.isNotNull(), 15.0).otherwise(F.col("confidence")).alias("confidence"),
        F.array_compact(F.transform("proof", lambda x: F.coalesce(x, gap))).alias("evidence"),
        "container",
    )
    return {
        "_sig": signature_index(data),
        "_ext": names.extension(F.col("file_name")),
        "_text": F.when(F.col("_sig").isNull() & F.col("textual"), content.text(data, PROBE_BYTES)),
        "zip": zip_scan(F.when(at("zip"), data)),
        "_probe": text_kind(own_text, json_kind("_text")),
        "_lines": F.when(own_text.isNotNull() & F.col("_probe").isNull(), first_lines(own_text)),
        "_delimited": F.when(F.col("_lines").isNotNull(), delimiter(F.col("_lines"))),
        # Never null, for the planner too: a filter on the type would else test the key below, where it is built once more.
        "_key": F.coalesce(key, F.lit("unknown")),
        "_varying": varying,
        "detection": detection,
    }


def with_detection(blobs: DataFrame) -> DataFrame:
    """`blobs` (file_name, content) with statistics, `zip`, and `detection`, the registry's row of what a file is.

    detection: type, label, mime, category, extension, confidence, evidence, container. Null or empty contents: unknown.
    A key says which row it is; the rows, some eighty, are joined to it by broadcast.
    """
    own = _expressions()
    # Statistics and directories are asked for in one step: each step of Python has workers of its own in every task.
    df = content.with_stats(blobs.withColumn("_sig", own["_sig"]), zip=own["zip"])
    for names_ in (("_ext", "_text"), ("_probe",), ("_lines",), ("_delimited",), ("_key", "_varying")):
        df = df.withColumns({c: own[c] for c in names_})
    registry = blobs.sparkSession.createDataFrame(registry_rows(), _FIELDS)
    df = df.join(F.broadcast(registry), df["_key"] == registry["key"], "left")
    return df.select(*blobs.columns, *(c for c in df.columns if c in KEPT and c not in blobs.columns), own["detection"].alias("detection"))


def with_extension(detected: DataFrame) -> DataFrame:
    """declared_extension, extension_match and recommended_extension of detected blobs."""
    ext = names.extension(F.col("file_name"))
    match = names.extension_match(ext, F.col("detection.type"), F.col("detection.extension"))
    return detected.withColumns({"declared_extension": ext, "extension_match": match}).withColumn("recommended_extension", names.recommended_extension(F.col("extension_match"), F.col("detection.extension")))
