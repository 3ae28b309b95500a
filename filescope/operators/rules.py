"""The deterministic rule engine: findings in their fixed order, a score, and a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescope.functions import content
from filescope.functions.lazy import once
from filescope.functions.registry import API_BYTES, API_NAMES, BAD_URL_PATTERN, COMPRESSED_TYPES, FINDINGS, NAME_RULES, PDF_BYTES, PDF_RULES, RISK_LEVELS, RUNNABLE_TYPES, SCRIPT_BYTES, SCRIPT_RULES, SCRIPT_TYPES, URL_PATTERN, ZIP_TYPES, Rule
from filescope.functions.names import is_executable

_FIELDS = ["category", "severity", "description", "evidence", "recommendation", "points"]
FINDING = "struct<" + ",".join(f"{f}:{'int' if f == 'points' else 'string'}" for f in _FIELDS) + ">"


def finding(category, severity, description, evidence, recommendation, points) -> Column:
    values = (category, severity, description, evidence, recommendation, points)
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("int" if f == "points" else "string").alias(f) for v, f in zip(values, _FIELDS, strict=True)))


def filled(template: str, *values) -> Column:
    """A text with values in the places of its {}."""
    first, *rest = template.split("{}")
    parts = [F.lit(first)]
    for value, text in zip(values, rest, strict=True):
        parts += [value, F.lit(text)]
    return F.concat(*parts)


def noted(rule: str, evidence, *values, advice: tuple = ()) -> Column:
    """The finding of a rule that is no pattern; `values` stand in its description, `advice` in its recommendation."""
    r = FINDINGS[rule]
    return finding(r.category, r.severity, filled(r.description, *values), evidence, filled(r.recommendation, *advice), r.points)


def apply_rule(rule: Rule, text: Column, cut: int | None = None) -> Column:
    """The rule's finding where its pattern is in `text`; null elsewhere."""
    if rule.piped is not None:
        hit = _piped(text, *rule.piped)
        fired = hit.isNotNull()
    elif cut is None:
        hit, fired = text, text.rlike(rule.pattern)
    else:
        hit = F.regexp_extract(text, rule.pattern, 0)
        fired = hit != ""
    evidence = F.lit(rule.evidence) if rule.evidence is not None else hit if cut is None else F.substring(hit, 1, cut)
    return F.when(fired, finding(rule.category, rule.severity, rule.description, evidence, rule.recommendation, rule.points))


def _piped(text: Column, before: str, after: str) -> Column:
    """The first stretch of `before`, a |, and `after`; null if there is none."""
    parts = F.split(text, r"\|", -1)
    n = F.size(parts)
    pairs = F.arrays_zip(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(parts, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    first = F.get(F.filter(pairs, lambda p: p["b"].rlike(after) & p["a"].rlike(before)), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.regexp_extract(first["a"], before, 0), F.lit("|"), F.regexp_extract(first["b"], after, 0)))


def level(score: Column, complete: Column) -> Column:
    out = F.when(~complete, "UNKNOWN")
    for least, name in RISK_LEVELS:
        out = out.when(score >= least, name)
    return out


def suspicious_urls(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(URL_PATTERN), 0), lambda u: u.rlike(BAD_URL_PATTERN))


def _zip_findings() -> list[Column]:
    entries, d = F.col("zip.entries"), F.col("detection.type")
    inside = d.isin(ZIP_TYPES) & F.col("zip.error").isNull() & entries.isNotNull()
    found = F.transform(entries, lambda e: e["name"])
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["uncompressed_size"])
    size = F.length("content")
    locked = F.size(F.filter(entries, lambda e: e["encrypted"]))

    def some(pattern: str) -> Column:
        return F.filter(found, lambda n: n.rlike(pattern))

    def listed(hits: Column) -> Column:
        return F.array_join(F.slice(hits, 1, 5), ", ")

    run, nested = some(r"(?i)\.(exe|dll|scr|bat|cmd|js|vbs|ps1|jar|msi|hta|com)\z"), some(r"(?i)\.(zip|rar|7z|gz|bz2|xz)\z")
    escaping = some(r"\.\./|\A/|(?i)\A[a-z]:\\")
    up = F.get(some(r"\.\./"), F.lit(0))
    rels = F.col("zip.rels")
    remote = rels.rlike("(?i)attachedTemplate|oleObject|frame") & rels.rlike('(?i)Target="https?:')
    target = F.coalesce(F.nullif(F.regexp_extract(rels, '(?i)Target="https?://[^"]+"', 0), F.lit("")), F.lit("remote target"))
    ratio = total / size
    whole = lambda x: F.floor(x + 0.5).cast("string")
    n = F.size(entries)
    return [
        F.when(inside & (F.size(some(r"(?i)vbaProject.*\.bin\z")) > 0), noted("Z1", "vbaProject.bin present in the container")),
        F.when(inside & (F.size(run) > 0), noted("Z2", listed(run))),
        F.when(inside & (F.size(nested) > 0), noted("Z3", listed(nested))),
        F.when(inside & (locked > 0), noted("Z4", F.concat(locked.cast("string"), F.lit(" encrypted entries")))),
        F.when(inside & (F.size(escaping) > 0), noted("Z5", F.coalesce(up, F.lit("absolute path entry")))),
        F.when(inside & (size > 0) & (ratio > 100) & (total > 50_000_000), noted("Z6", F.concat(F.lit("Ratio ≈ "), whole(ratio), F.lit(":1 ("), whole(total / 1_000_000), F.lit(" MB expanded)")))),
        F.when(inside & (n > 1000), noted("Z7", filled("{} entries", n.cast("string")), n.cast("string"))),
        F.when(inside & remote, noted("Z8", target)),
    ]


@once
def _findings() -> tuple[Column, Column]:
    """All findings of a blob in their order, and what stands for none."""
    kind, label, category = (F.col(f"detection.{c}") for c in ("type", "label", "category"))
    name, declared, entropy = F.col("file_name"), F.col("declared_extension"), F.col("entropy")
    pdf, script, binary = F.col("_pdf"), F.col("_script"), F.col("_binary")
    hidden = category == "binary"
    runs = kind.isin(RUNNABLE_TYPES)
    claim = filled("Declared .{} · Detected {} ({}% confidence)", declared, kind, number(F.col("detection.confidence")))
    right = (F.col("detection.extension"),)
    mismatch = F.when(hidden, noted("R5a", claim, declared, label)).otherwise(noted("R5b", claim, declared, label, advice=right))
    runnable = filled("Detected type: {}", kind)
    urls = suspicious_urls(script)
    apis = F.filter(F.array(*(F.when(F.contains(binary, F.lit(a.encode())), F.lit(a)) for a in API_NAMES)), lambda a: a.isNotNull())
    formula = F.regexp_extract(script, r"(?m)^[=+\-@].{0,60}", 0)
    broken = kind.isin(ZIP_TYPES) & F.col("zip.error").isNotNull()
    all_rules = [
        *(apply_rule(r, name) for r in NAME_RULES),
        F.when(F.col("extension_match") == F.lit(False), mismatch),
        F.when(F.col("extension_match").isNull(), noted("R6", name, advice=right)),
        F.when(hidden | is_executable(declared), F.when(runs, noted("R7a", runnable, label)).otherwise(noted("R7b", runnable, label))),
        F.when((entropy >= 7.5) & ~kind.isin(COMPRESSED_TYPES), noted("R8", F.concat(F.lit("Shannon entropy "), number(entropy), F.lit(" bits/byte")))),
        F.when(kind == "unknown", noted("R9", F.concat(F.lit("Header bytes: "), F.col("header_hex")))),
        *(apply_rule(r, pdf) for r in PDF_RULES),
        *_zip_findings(),
        *(apply_rule(r, script, 120) for r in SCRIPT_RULES),
        F.when((kind == "csv") & script.rlike(r"(?m)^[=+\-@]"), noted("C10", formula)),
        F.when(F.size(urls) > 0, noted("C11", F.substring(F.array_join(F.slice(urls, 1, 3), ", "), 1, 200), F.size(urls).cast("string"))),
        F.when(F.size(apis) >= 2, noted("X1", F.array_join(F.slice(apis, 1, 6), ", "))),
        F.when((category == "image") & ~broken & F.contains(F.substring("content", 1, SCRIPT_BYTES), F.lit(b"PK\x03\x04")), noted("Y1", "ZIP local file header found inside image data")),
        F.when(broken, noted("E1", F.col("zip.error"))),
    ]
    found = F.filter(F.array(*all_rules), lambda x: x.isNotNull())
    none = F.array(noted("none", filled("{} · entropy {}", label, number(entropy))))
    return found, none


def with_risk(df: DataFrame) -> DataFrame:
    """Detected blobs with their extensions judged, and findings, risk_score, risk_level, scan_complete, scanned_in_part.

    scanned_in_part: rules read a prefix, as for all files of the type, and the file is longer. A blob without content
    (too large, or null) is of unknown type, so its scan is incomplete. Decoded texts are columns of their own, null where no rule reads them, so that no rule decodes again.
    """
    kind, category = (F.col(f"detection.{c}") for c in ("type", "category"))
    found, none = _findings()
    broken = kind.isin(ZIP_TYPES) & F.col("zip.error").isNotNull()
    df = df.withColumns(
        {
            "_pdf": F.when(kind == "pdf", content.text(F.col("content"), PDF_BYTES)),
            "_script": F.when(kind.isin(SCRIPT_TYPES), content.text(F.col("content"), SCRIPT_BYTES)),
            "_binary": F.when(kind.isin("pe", "elf"), F.substring("content", 1, API_BYTES)),
        }
    )
    locked = F.coalesce(F.exists("zip.entries", lambda e: e["encrypted"]), F.lit(False)) & kind.isin(ZIP_TYPES)
    size = F.col("size") if "size" in df.columns else F.coalesce(F.length("content"), F.lit(0))
    read = F.when(kind == "pdf", PDF_BYTES).when(kind.isin("pe", "elf"), API_BYTES).when(kind.isin(SCRIPT_TYPES) | (category == "image"), SCRIPT_BYTES)
    part = F.coalesce(size > read, F.lit(False))
    df = df.withColumn("_found", found).withColumn("findings", F.when(F.size("_found") > 0, F.col("_found")).otherwise(none))
    score = F.least(F.lit(100), F.aggregate("findings", F.lit(0), lambda a, x: a + x["points"]))
    df = df.withColumns({"risk_score": score, "scan_complete": ~((kind == "unknown") | broken | locked), "scanned_in_part": part})
    return df.withColumn("risk_level", level(F.col("risk_score"), F.col("scan_complete"))).drop("_pdf", "_script", "_binary", "_found")


def number(x: Column) -> Column:
    """A double as JavaScript writes it, for values of few decimals: no fraction for whole ones."""
    return F.regexp_replace(x.cast("string"), r"\.0\z", "")
