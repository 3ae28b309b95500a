"""The registered queries of the file-analysis operators, each with the SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.functions import content, names, textual
from filescope.functions import registry as R
from filescope.operators import analyze, catalog, detect, extract, profile, prompts, rules
from filescope.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _case(rule: R.Rule, text: str) -> str:
    return f"case when regexp_matches({text}, '{rule.pattern}') then {rule.points} else 0 end"


def _fired(some: list[R.Rule], text: str) -> str:
    return " || ".join(f"case when regexp_matches({text}, '{r.pattern}') then '{r.id} ' else '' end" for r in some)


def _points(some: list[R.Rule], text: str) -> str:
    return " + ".join(_case(r, text) for r in some)


def _level(score: str) -> str:
    return "case " + " ".join(f"when {score} >= {n} then '{name}'" for n, name in R.RISK_LEVELS) + " end"


_URLS = f"len(list_filter(regexp_extract_all(html, '{R.URL_PATTERN}'), lambda u: regexp_matches(u, '{R.BAD_URL_PATTERN}')))"
_PAGE_SCORE = f"least(100, {_points(R.SCRIPT_RULES, 'html')} + case when {_URLS} > 0 then 12 else 0 end)"

# --- hashes, statistics, names --------------------------------------


@query("select doc_id as blob_id, octet_length(encode(text)) as size, sha256(text) as sha256, sha1(text) as sha1, md5(text) as md5 from documents")
def blob_hashes(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return content.with_hashes(X.source.from_table(d, "doc_id", F.lit("a.txt"), F.col("text"))).select("blob_id", "size", "sha256", "sha1", "md5")


@query(f"select blob_id, rtrim(regexp_replace(hex(content)[1:32], '(..)', '\\1 ', 'g')) as header_hex from ({X.forged_sql()})")
def header_hex(spark, sf_dir):
    return X.forged(spark, sf_dir).select("blob_id", content.header_hex(F.col("content")).alias("header_hex"))


@query(
    f"""with b as (select blob_id, octet_length(content) as n, hex(content) as h from ({X.forged_sql()})),
    c as (select blob_id, n, h[2 * i + 1:2 * i + 2] as x, count(*) as c from b, unnest(range(n)) as r(i) group by all),
    v as (select *, ('0x' || x)::integer as v from c)
    select blob_id, round(sum(-(c / n) * log2(c / n)) + 0.0, 3) as entropy,
      round(sum(case when v in (9, 10, 13) or v between 32 and 126 then c else 0 end) / any_value(n), 9) as printable_ratio, round(sum(case when v = 0 then c else 0 end) / any_value(n), 9) as null_ratio
    from v group by blob_id"""
)
def byte_stats(spark, sf_dir):
    s = content.with_stats(X.forged(spark, sf_dir))
    return s.select("blob_id", "entropy", F.round("printable_ratio", 9).alias("printable_ratio"), F.round("null_ratio", 9).alias("null_ratio"))


_EXT_SQL = "nullif(lower(regexp_extract(list_extract(string_split(replace({0}, chr(92), '/'), '/'), -1), '\\A[\\s\\S]+\\.([^.]+)\\z', 1)), '')"


@query(f"select page_id, {_EXT_SQL.format('url')} as declared_extension from pages")
def declared_extension(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", names.extension(F.col("url")).alias("declared_extension"))


@query("select page_id, coalesce(nullif(list_extract(string_split(replace(url, chr(92), '/'), '/'), -1)[1:255], ''), 'file') as file_name from pages")
def sanitized_names(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", names.sanitize(F.col("url")).alias("file_name"))


# --- detection ------------------------------------------------------


@query(f"select blob_id, type, label, mime, category, extension, confidence from ({X.forged_sql()}) join {X.forged_types_sql()} using (k)")
def signature_detect(spark, sf_dir):
    return detect.with_detection(X.forged(spark, sf_dir)).select("blob_id", *(f"detection.{c}" for c in ("type", "label", "mime", "category", "extension", "confidence")))


@query(f"select type, category, count(*) as n from ({X.forged_sql()}) join {X.forged_types_sql()} using (k) group by all")
def forged_type_counts(spark, sf_dir):
    return detect.with_detection(X.forged(spark, sf_dir)).groupBy("detection.type", "detection.category").agg(F.count(F.lit(1)).alias("n"))


_EXT_VALUES = "(values " + ", ".join(f"('{e}', '{t}')" for e, t in R.EXTENSION_MAP.items()) + ") as m(ext, expected)"
_ALIAS_VALUES = "(values " + ", ".join(f"('{t}', '{e}')" for t, es in R.ALIASES.items() for e in es.split()) + ") as a(type, ext)"
_FORGED_EXT = f"""forged as (select *, {_EXT_SQL.format("file_name")} as ext from ({X.forged_sql()}) join {X.forged_types_sql()} using (k)),
    judged as (select f.*, case when ext is null then null else coalesce(m.expected = f.type, false) or (case when f.type in (select type from {_ALIAS_VALUES}) then (f.type, ext) in (select (type, ext) from {_ALIAS_VALUES}) else ext = f.extension end) end as match
      from forged f left join {_EXT_VALUES} using (ext))"""


@query(f"with {_FORGED_EXT} select blob_id, ext as declared_extension, match as extension_match, case when match then null else nullif(extension, '') end as recommended_extension from judged")
def extension_check(spark, sf_dir):
    return detect.with_extension(detect.with_detection(X.forged(spark, sf_dir))).select("blob_id", "declared_extension", "extension_match", "recommended_extension")


@query(
    """select blob_id, case when n > 64 and p + 4 < n and hex(content)[2 * p + 1:2 * p + 4] = '5045' then true else false end as is_pe from (
    select doc_id as blob_id, unhex('4D5A' || repeat('00', 58) || (['40000000', '41000000', 'FFFFFF00'])[doc_id % 3 + 1] || '50450000') || encode(text) as content, octet_length(content) as n, ([64, 65, 16777215])[doc_id % 3 + 1] as p from documents)"""
)
def pe_refine(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    body = F.concat(F.lit(b"MZ" + bytes(58)), F.unhex(X.pick(["40000000", "41000000", "FFFFFF00"], F.col("doc_id"))), F.lit(b"PE\0\0"), F.encode("text", "UTF-8"))
    return X.source.from_table(d, "doc_id", F.lit("a.exe"), body).select("blob_id", detect.is_pe(F.col("content")).alias("is_pe"))


@query("select doc_id as blob_id, (['heic', 'heic', 'mp4', 'mov', 'm4a'])[doc_id % 5 + 1] as type, cast((['96', '98', '96', '96', '97'])[doc_id % 5 + 1] as double) as confidence from documents")
def brand_refine(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    brand = X.pick(["mif1", "heic", "isom", "qt  ", "M4A "], F.col("doc_id"))
    blobs = X.source.from_table(d, "doc_id", F.lit("a.mp4"), F.concat(F.lit(b"\0\0\0\x18ftyp"), F.encode(brand, "UTF-8"), F.encode("text", "UTF-8")))
    return detect.with_detection(blobs).select("blob_id", "detection.type", "detection.confidence")


@query("select page_id as blob_id, 'html' as type, cast(94 as double) as confidence, 'Textual content matched a structural pattern' as evidence from pages")
def text_probe_pages(spark, sf_dir):
    return detect.with_detection(X.pages(spark, sf_dir)).select("blob_id", "detection.type", "detection.confidence", F.array_join("detection.evidence", "; ").alias("evidence"))


_PROBES = [
    ("<?xml version='1.0'?> <svg >", "svg"), ("<svg>", "svg"), ("<!DOCTYPE html>", "html"), ("<?xml?>", "xml"), ("-- create  table x", "sql"), ("SELECT 1 ;", "sql"), ("#!/bin/sh", "script"), ("import x", "script"), ("--- ", "plain"), ("# head", "markdown"), ("", "plain"), ("[a](b)", "markdown"),
]


@query(
    f"""select doc_id as blob_id, case when want <> 'plain' then want when regexp_matches(t, '\\A\\s*(#|---)') and regexp_matches(t, '(?m)^[\\w.\\x22\\x27-]+\\s*:\\s*\\S') then 'yaml'
      when regexp_matches(t, '(?m)^\\s*(import |from |def |function |const |package |#include)') then 'script' when regexp_matches(t, '\\A\\s{{0,3}}#{{1,6}}\\s|\\n\\s{{0,3}}#{{1,6}}\\s|\\[[^\\]]+\\]\\([^)]+\\)') then 'markdown'
      else 'other' end as probe
    from (select doc_id, {X.pick_sql([p for p, _ in _PROBES], "doc_id")} || chr(10) || text as t, {X.pick_sql([w for _, w in _PROBES], "doc_id")} as want from documents)"""
)
def text_probe_documents(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    text = F.concat(X.pick([p for p, _ in _PROBES], F.col("doc_id")), F.lit("\n"), "text")
    found = detect.with_detection(X.source.from_table(d, "doc_id", F.lit("a"), text))
    kind = F.col("detection.type")
    return found.select("blob_id", F.when(kind.isin("txt", "csv", "tsv"), "other").otherwise(kind).alias("probe"))


@query("select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then 'json' else 'jsonl' end as kind from events")
def json_probe_events(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit(" x"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat("props", F.lit("\n"), "props"))
    return e.select("event_id", text.alias("t")).select("event_id", detect.json_kind("t").alias("kind"))


@query(
    """select c_custkey, case when c_custkey % 4 = 3 then null else (['csv', 'tsv', 'ssv'])[c_custkey % 4 + 1] end as kind, case when c_custkey % 4 = 3 then null else 3 end as columns from customer"""
)
def delimited_probe(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    mark = X.pick([",", "\t", ";", " "], F.col("c_custkey"))
    line = F.concat_ws("", F.col("c_name"), mark, F.col("c_nationkey").cast("string"), mark, F.col("c_mktsegment"))
    text = F.concat(line, F.lit("\n\n"), line, F.lit("\r\n"), line)
    return c.select("c_custkey", detect.first_lines(text).alias("lines")).select("c_custkey", detect.delimiter(F.col("lines")).alias("d")).select("c_custkey", "d.kind", "d.columns")


# --- rules ----------------------------------------------------------


@query(f"select blob_id, trim({_fired(R.NAME_RULES, 'file_name')}) as fired, {_points(R.NAME_RULES, 'file_name')} as points from ({X.forged_sql()})")
def filename_rules(spark, sf_dir):
    return _rule_result(X.forged(spark, sf_dir), R.NAME_RULES, F.col("file_name"))


def _rule_result(df: DataFrame, some: list[R.Rule], text, key: str = "blob_id") -> DataFrame:
    t = df.select(key, text.alias("t"))
    fired = F.concat(*(F.when(F.col("t").rlike(r.pattern), r.id + " ").otherwise("") for r in some))
    points = sum((F.coalesce(rules.apply_rule(r, F.col("t"))["points"], F.lit(0)) for r in some), F.lit(0))
    return t.select(key, F.trim(fired).alias("fired"), points.alias("points"))


@query(f"select page_id as blob_id, trim({_fired(R.SCRIPT_RULES, 'html')}) as fired, {_points(R.SCRIPT_RULES, 'html')} as points from pages")
def script_rules_pages(spark, sf_dir):
    return _rule_result(X.pages(spark, sf_dir), R.SCRIPT_RULES, content.text(F.col("content"), R.SCRIPT_BYTES))


@query(f"select doc_id as blob_id, trim({_fired(R.SCRIPT_RULES, 'text')}) as fired, {_points(R.SCRIPT_RULES, 'text')} as points from ({X.suffixed_sql('', X.SCRIPT_SUFFIXES)})")
def script_rules_documents(spark, sf_dir):
    return _rule_result(X.suffixed(spark, sf_dir, "", X.SCRIPT_SUFFIXES, "txt"), R.SCRIPT_RULES, content.text(F.col("content"), R.SCRIPT_BYTES))


@query(f"select doc_id as blob_id, trim({_fired(R.PDF_RULES, 'text')}) as fired, {_points(R.PDF_RULES, 'text')} as points from ({X.suffixed_sql('%PDF-1.4 ', X.PDF_SUFFIXES)})")
def pdf_rules(spark, sf_dir):
    return _rule_result(X.suffixed(spark, sf_dir, "%PDF-1.4 ", X.PDF_SUFFIXES, "pdf"), R.PDF_RULES, content.text(F.col("content"), R.PDF_BYTES))


@query(f"select doc_id, len(u) as n, array_to_string(u[1:3], ', ')[1:200] as evidence from (select doc_id, list_filter(regexp_extract_all(text, '{R.URL_PATTERN}'), lambda x: regexp_matches(x, '{R.BAD_URL_PATTERN}')) as u from ({X.suffixed_sql('', X.SCRIPT_SUFFIXES)})) where len(u) > 0")
def suspicious_urls(spark, sf_dir):
    text = F.concat("text", F.lit("\n"), X.pick(X.SCRIPT_SUFFIXES, F.col("doc_id")))
    d = X.table(spark, sf_dir, "documents").select("doc_id", rules.suspicious_urls(text).alias("u")).filter(F.size("u") > 0)
    return d.select("doc_id", F.size("u").cast("long").alias("n"), F.substring(F.array_join(F.slice("u", 1, 3), ", "), 1, 200).alias("evidence"))


@query("""select page_id, url, regexp_matches(url, '""" + R.BAD_URL_PATTERN + """') as bad from pages""")
def page_url_check(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", "url", F.col("url").rlike(R.BAD_URL_PATTERN).alias("bad"))


@query(f"select doc_id, regexp_extract(text, '(?m)^[=+\\-@].{{0,60}}') as evidence from ({X.suffixed_sql('', X.SCRIPT_SUFFIXES)}) where regexp_matches(text, '(?m)^[=+\\-@]')")
def csv_injection(spark, sf_dir):
    text = F.concat("text", F.lit("\n"), X.pick(X.SCRIPT_SUFFIXES, F.col("doc_id")))
    d = X.table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).filter(F.col("t").rlike(r"(?m)^[=+\-@]"))
    return d.select("doc_id", F.regexp_extract("t", r"(?m)^[=+\-@].{0,60}", 0).alias("evidence"))


_APIS = "[" + ", ".join(f"'{a}'" for a in R.API_NAMES) + "]"


@query(f"select doc_id as blob_id, array_to_string(a[1:6], ', ') as apis from (select doc_id, list_filter({_APIS}, lambda x: contains(text, x)) as a from ({X.suffixed_sql('MZ', X.API_SUFFIXES)})) where len(a) >= 2")
def api_imports(spark, sf_dir):
    found = analyze.assess(X.suffixed(spark, sf_dir, "MZ", X.API_SUFFIXES, "exe"))
    hit = F.get(F.filter("findings", lambda f: f["category"] == "Static imports"), F.lit(0))
    return found.select("blob_id", hit["evidence"].alias("apis")).filter(F.col("apis").isNotNull())


@query("select doc_id as blob_id from documents where doc_id % 3 = 0 or contains(text, 'PK' || chr(3) || chr(4))")
def polyglot(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit(b"PK\x03\x04")).otherwise(F.lit(b""))
    found = analyze.assess(X.source.from_table(d, "doc_id", F.lit("a.gif"), F.concat(F.lit(b"GIF89a"), F.encode("text", "UTF-8"), tail)))
    return found.filter(F.exists("findings", lambda f: f["category"] == "Polyglot file")).select("blob_id")


_FORGED_RISK = f"""{_FORGED_EXT}, scored as (select *, least(100, {_points(R.NAME_RULES, 'file_name')} + case when match = false then case when category = 'binary' then 45 else 18 end when match is null then 5 else 0 end
      + case when category = 'binary' or ext in ({", ".join(f"'{e}'" for e in R.EXECUTABLE)}) then case when type in ({", ".join(f"'{t}'" for t in R.RUNNABLE_TYPES)}) then 40 else 20 end else 0 end
      + case when broken then 10 else 0 end) as score from judged)"""


@query(f"with {_FORGED_RISK} select blob_id, type, cast(score as integer) as risk_score, case when broken then 'UNKNOWN' else {_level('score')} end as risk_level, not broken as scan_complete from scored")
def risk_score(spark, sf_dir):
    return analyze.assess(X.forged(spark, sf_dir)).select("blob_id", "detection.type", "risk_score", "risk_level", "scan_complete")


@query(f"with {_FORGED_RISK} select category, case when broken then 'UNKNOWN' else {_level('score')} end as risk_level, count(*) as n, cast(sum(score) as bigint) as points from scored group by all")
def risk_level_summary(spark, sf_dir):
    return analyze.assess(X.forged(spark, sf_dir)).groupBy("detection.category", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("points"))


@query(f"select 'html' as detected_type, {_level(_PAGE_SCORE)} as risk_level, count(*) as n, cast(max({_PAGE_SCORE}) as integer) as most from pages group by all")
def page_risk_summary(spark, sf_dir):
    return analyze.assess(X.pages(spark, sf_dir)).groupBy(F.col("detection.type").alias("detected_type"), "risk_level").agg(F.count(F.lit(1)).alias("n"), F.max("risk_score").alias("most"))


def _exploded_sql() -> str:
    parts = [f"select doc_id, {i} as rank, '{r.severity}' as severity, '{r.description}' as description, {r.points} as points, regexp_extract(text, '{r.pattern}')[1:120] as evidence from t where regexp_matches(text, '{r.pattern}')" for i, r in enumerate(R.SCRIPT_RULES)]
    return f"with t as ({X.suffixed_sql('', X.SCRIPT_SUFFIXES)}), u as ({' union all '.join(parts)})"


@query(_exploded_sql() + " select cast(doc_id as varchar) as file_id, cast(row_number() over (partition by doc_id order by rank) - 1 as integer) as position, severity, description, points, evidence from u")
def findings_exploded(spark, sf_dir):
    return X.findings(spark, sf_dir).select("file_id", "position", "severity", "description", "points", "evidence")


# --- catalogue ------------------------------------------------------

_USER = "u3"
_LATEST = f"with {X.CATALOGUE_SQL}, mine as (select * from f where user_id = '{_USER}'), latest as (select * from mine order by created_at desc, id limit 200)"
_ALERTS = ", ".join(f"'{x}'" for x in R.ALERT_LEVELS)


def _mine(spark, sf_dir):
    return catalog.visible(X.catalogue(spark, sf_dir), _USER)


@query(f"{_LATEST} select count(*) as total, count(*) filter (risk_level in ('SAFE', 'LOW')) as safe, count(*) filter (risk_level = 'MEDIUM') as suspicious, count(*) filter (risk_level = 'HIGH') as high, count(*) filter (risk_level = 'CRITICAL') as critical from latest")
def dashboard_counts(spark, sf_dir):
    return catalog.dashboard_counts(_mine(spark, sf_dir))


@query(f"{_LATEST}, r as (select *, row_number() over (order by created_at desc, id) as rn from latest), g as (select detected_type, count(*) as n, min(rn) as first from r group by 1) select detected_type, n, greatest(6.0, n * 100.0 / (sum(n) over ()))::double as width from g order by n desc, first limit 8")
def type_distribution(spark, sf_dir):
    return catalog.type_distribution(_mine(spark, sf_dir))


@query(f"{_LATEST} select id, risk_level, created_at from latest where risk_level in ({_ALERTS}) order by created_at desc, id limit 5")
def dashboard_alerts(spark, sf_dir):
    return catalog.alert_preview(_mine(spark, sf_dir)).select("id", "risk_level", "created_at")


@query(f"{_LATEST} select id, detected_type, created_at from latest order by created_at desc, id limit 8")
def recent_files(spark, sf_dir):
    return catalog.recent(_mine(spark, sf_dir)).select("id", "detected_type", "created_at")


@query(f"with {X.CATALOGUE_SQL} select id, risk_score, risk_level from f where risk_level in ({_ALERTS}) order by risk_score desc, id limit 200")
def alerts(spark, sf_dir):
    return catalog.alerts(X.catalogue(spark, sf_dir)).select("id", "risk_score", "risk_level")


@query(f"with {X.CATALOGUE_SQL} select id, user_id, created_at from f order by created_at desc, id limit 300")
def history(spark, sf_dir):
    return catalog.history(X.catalogue(spark, sf_dir)).select("id", "user_id", "created_at")


@query(f"with {X.CATALOGUE_SQL}, r as (select *, row_number() over w as n, first_value(id) over w as duplicate_of from f window w as (partition by user_id, sha256 order by created_at, id)) select id, user_id, duplicate_of from r where n > 1")
def duplicates(spark, sf_dir):
    return catalog.duplicates(X.catalogue(spark, sf_dir)).select("id", "user_id", "duplicate_of")


@query(f"with {X.CATALOGUE_SQL} select distinct a.id, a.user_id, a.sha256 from f a join f b on a.user_id = b.user_id and a.sha256 = b.sha256 cross join (select (min(epoch_us(created_at)) + max(epoch_us(created_at))) // 2 as half from f) where epoch_us(a.created_at) >= half and epoch_us(b.created_at) < half")
def duplicate_lookup(spark, sf_dir):
    """Files of the later half that their user had in the earlier one."""
    f = X.catalogue(spark, sf_dir)
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    ends = f.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    half = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    new, old = f.filter(at >= half), f.filter(at < half)
    return catalog.is_duplicate(new, old).select("id", "user_id", "sha256")


_FINDINGS = _exploded_sql() + ", findings as (select cast(doc_id as varchar) as file_id, cast(row_number() over (partition by doc_id order by rank) - 1 as integer) as position, severity, description, points from u), " + X.CATALOGUE_SQL


@query(f"{_FINDINGS} select file_id, position, severity, points from findings where exists (select 1 from f where f.id = file_id and user_id = '{_USER}')")
def tenant_findings(spark, sf_dir):
    mine = _mine(spark, sf_dir)
    return catalog.of_files(X.findings(spark, sf_dir, mine), mine).select("file_id", "position", "severity", "points")


_MESSAGES = "m as (select cast(conv_id as varchar) as file_id, turn, role, text from conversations)"


@query(
    f"""{_FINDINGS}, {_MESSAGES}, a as (select file_id, string_agg(severity || ':' || points, ',' order by points desc, position) as found, count(*) as n from findings group by 1), b as (select file_id, string_agg(role, ',' order by turn) as roles from m group by 1)
    select id, risk_level, coalesce(a.n, 0) as n_findings, coalesce(a.found, '') as found, coalesce(b.roles, '') as roles from f left join a on a.file_id = id left join b on b.file_id = id"""
)
def file_report(spark, sf_dir):
    f = X.catalogue(spark, sf_dir)
    r = catalog.report(f, X.findings(spark, sf_dir, f), X.messages(spark, sf_dir))
    found = F.transform("findings", lambda f: F.concat(f["severity"], F.lit(":"), f["points"].cast("string")))
    roles = F.transform("messages", lambda m: m["role"])
    return r.select("id", "risk_level", F.coalesce(F.size("findings").cast("long"), F.lit(0)).alias("n_findings"), F.coalesce(F.array_join(found, ","), F.lit("")).alias("found"), F.coalesce(F.array_join(roles, ","), F.lit("")).alias("roles"))


@query(f"{_FINDINGS}, r as (select *, row_number() over (partition by file_id order by points desc, position) as rank from findings where severity in ('high', 'critical') and file_id in (select id from f where risk_level in ('HIGH', 'CRITICAL'))) select file_id, cast(rank as integer) as rank, severity, points from r where rank <= 5")
def top_findings_banner(spark, sf_dir):
    return catalog.banner(X.catalogue(spark, sf_dir), X.findings(spark, sf_dir)).select("file_id", "rank", "severity", "points")


def _last_sql(n: int) -> str:
    return f"with {_MESSAGES}, r as (select *, row_number() over (partition by file_id order by turn desc) as n from m) select file_id, cast(row_number() over (partition by file_id order by turn) as integer) as place, role, text as content from r where n <= {n}"


@query(_last_sql(10))
def chat_last10(spark, sf_dir):
    return catalog.last_messages(X.messages(spark, sf_dir)).select("file_id", "place", "role", "content")


@query(_last_sql(3))
def chat_last3(spark, sf_dir):
    return catalog.last_messages(X.messages(spark, sf_dir), 3).select("file_id", "place", "role", "content")


@query(
    f"""with {X.CATALOGUE_SQL}, t as (select f.*, d.text from f join documents d on cast(d.doc_id as varchar) = f.id)
    select id, md5('FILE: ' || id || ' (' || detected_type || ')' || chr(10) || 'SECURITY VERDICT (authoritative): ' || risk_level || chr(10) || '{prompts.BEGIN}' || chr(10) || coalesce(nullif(text[1:{prompts.CONTENT_LIMIT}], ''), '{prompts.NOTHING}') || chr(10) || '{prompts.STOP}') as prompt_md5 from t"""
)
def chat_prompt(spark, sf_dir):
    f, d = X.catalogue(spark, sf_dir), X.table(spark, sf_dir, "documents")
    j = f.join(d.select(F.col("doc_id").cast("string").alias("_id"), "text"), F.col("id") == F.col("_id"))
    return j.select("id", F.md5(prompts.question_context(F.col("id"), F.col("detected_type"), F.col("risk_level"), F.col("text"))).alias("prompt_md5"))


_DELETED = "deleted as (select id from f where cast(id as bigint) % 5 = 0)"


@query(f"{_FINDINGS}, {_DELETED} select 'files' as t, count(*) as n from f where id not in (select id from deleted) union all select 'findings', count(*) from findings where file_id not in (select id from deleted) union all select 'messages', count(*) from conversations where cast(conv_id as varchar) not in (select id from deleted) union all select 'analyses', count(*) from pages where page_id % 5 <> 0 or cast(page_id as varchar) not in (select id from f)")
def cascade_delete(spark, sf_dir):
    f = X.catalogue(spark, sf_dir)
    dead = f.filter(F.col("id").cast("long") % 5 == 0)
    counted = lambda name, df: df.agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n")).select("t", "n")
    parts = [counted("files", catalog.without(f, dead)), counted("findings", catalog.without(X.findings(spark, sf_dir), dead, "file_id")), counted("messages", catalog.without(X.messages(spark, sf_dir), dead, "file_id"))]
    analyses = X.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_id"))
    parts.append(counted("analyses", catalog.without(analyses, dead, "file_id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"with {X.CATALOGUE_SQL} select cast(created_at as date) as day, risk_level, count(*) as n from f group by all")
def daily_risk_trend(spark, sf_dir):
    return catalog.risk_trend(X.catalogue(spark, sf_dir))


_LABELS = "case risk_level " + " ".join(f"when '{k}' then '{v}'" for k, v in R.RISK_LABELS.items()) + " end"


@query(f"with {X.CATALOGUE_SQL} select {_LABELS} as label, count(*) as n from f group by all")
def risk_labels(spark, sf_dir):
    return X.catalogue(spark, sf_dir).groupBy(catalog.risk_label(F.col("risk_level")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) else printf('%.2f MB', floor(n / 1048576.0 * 100 + 0.5) / 100) end as size from (select doc_id, octet_length(encode(text)) * 37 as n from documents)")
def formatted_sizes(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", textual.format_bytes(F.octet_length("text").cast("long") * 37).alias("size"))


# --- text extraction and profiles -----------------------------------

_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s{2,}', ' ', 'g')"


@query(f"select page_id, md5(trim({_STRIPPED}, ' ' || chr(9) || chr(10) || chr(13))) as text_md5 from pages")
def html_text(spark, sf_dir):
    text, _ = textual.clamp(textual.strip_html(F.col("html")), 1 << 30)
    return X.table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"))


@query("""select page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]{1,200})</title>', 1)), '') as title, len(regexp_extract_all(html, '(?i)<([a-z][\\w:-]*)')) as elements, len(regexp_extract_all(html, '(?i)href\\s*=\\s*[\\x22\\x27][^\\x22\\x27]+')) as links from pages""")
def html_stats(spark, sf_dir):
    s = textual.markup_stats(F.col("html"))
    return X.table(spark, sf_dir, "pages").select("page_id", s["title"].alias("title"), s["elements"].cast("long").alias("elements"), s["links"].cast("long").alias("links"))


@query("select doc_id, length(text) as characters, len(string_split_regex(text, '\\r?\\n')) as lines, len(regexp_extract_all(text, '[^\\s\\x0B]+')) as words from documents")
def text_stats(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(n) for n, c in textual.text_stats(F.col("text")).items()))


def _clamp_sql(limit: int) -> str:
    plain = "trim(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
    return f"select doc_id, md5({plain}[1:{limit}]) as text_md5, length({plain}) > {limit} as truncated from documents"


@query(_clamp_sql(1000))
def clamp_text(spark, sf_dir):
    text, cut = textual.clamp(F.col("text"), 1000)
    return X.table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("text_md5"), cut.alias("truncated"))


def _profile_sql() -> str:
    cells = "with c as (unpivot (select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, case when c_custkey % 4 = 0 then '' else c_mktsegment end as c_mktsegment, case when c_custkey % 3 = 0 then '' else cast(c_nationkey as varchar) end as sparse from customer) on columns(*) into name \"column\" value v), "
    flags = "x as (select *, trim(v) = '' as blank, regexp_matches(v, '\\A-?\\d+\\z') as i, case when trim(v) = '' then 0.0 when regexp_matches(v, '\\A[+-]?(\\d+\\.?\\d*|\\.\\d+)\\z') then cast(v as double) end as x from c), "
    agg = "a as (select \"column\", count(*) as rows, count(*) filter (blank) as missing, bool_and(i) filter (not blank) as i, count(x) as numeric, min(x) as lo, max(x) as hi, avg(x) as mid, count(distinct v) as \"distinct\" from x group by 1)"
    return cells + flags + agg + " select \"column\", case when rows = missing then 'empty' when i then 'integer' else 'text' end as inferred_type, missing, rows, numeric, case when numeric > rows * 0.6 then lo end as min, case when numeric > rows * 0.6 then hi end as max, case when numeric > rows * 0.6 then round(mid, 2) end as avg, \"distinct\" from a"


@query(_profile_sql())
def column_profile(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    shaped = c.select("c_custkey", "c_name", "c_nationkey", F.when(key % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(key % 3 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("sparse"))
    return profile.profile(profile.cells(shaped)).withColumn("avg", F.round("avg", 2))


@query("""select * from (values ('l_orderkey', 'integer'), ('l_quantity', 'number'), ('l_returnflag', 'text'), ('l_shipdate', 'date'), ('flag', 'boolean'), ('nothing', 'empty')) as t("column", inferred_type)""")
def infer_type(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem")
    shaped = li.select("l_orderkey", "l_quantity", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"), (F.col("l_linenumber") % 2 == 0).alias("flag"), F.lit(" ").alias("nothing"))
    return profile.profile(profile.cells(shaped)).select("column", "inferred_type")


@query(f"""select doc_id as blob_id, cast(len(s) as integer) as n, md5(array_to_string(s[1:400], chr(10))) as strings_md5 from (select doc_id, regexp_extract_all(text, '[\\x20-\\x7e]{{8,}}') as s from ({X.suffixed_sql('', [''])}))""")
def strings_extract(spark, sf_dir):
    one = F.pandas_udf(lambda s: s.map(lambda b: extract.strings(b or b"", 8, None, None)), "array<string>")
    found = X.suffixed(spark, sf_dir, "", [""], "bin").select("blob_id", one("content").alias("s"))
    return found.select("blob_id", F.size("s").alias("n"), F.md5(F.array_join(F.slice("s", 1, 400), "\n")).alias("strings_md5"))


# --- containers and formats -----------------------------------------

_EXTRA = X.pick_sql(X.ZIP_EXTRAS, "doc_id")


@query(f"""select doc_id as blob_id, 'f' || doc_id as name, cast(strlen(text) as bigint) as uncompressed_size, 0 as method, doc_id % 7 = 0 as encrypted from documents
    union all select doc_id, {_EXTRA}, 0, 0, false from documents where {_EXTRA} <> ''""")
def zip_entries(spark, sf_dir):
    extract.register(spark)
    X.zips(spark, sf_dir).createOrReplaceTempView("_zip_files")
    return spark.sql("select blob_id, e.name, e.uncompressed_size, e.method, e.encrypted from _zip_files, lateral zip_entries(content) e")


@query(f"""select doc_id as blob_id, case when doc_id % 7 = 0 then 20 else 0 end + ([0, 40, 15, 45, 35, 45])[doc_id % 6 + 1] + case when doc_id % 6 = 4 then 18 else 0 end as risk_score,
    doc_id % 7 <> 0 as scan_complete, case when doc_id % 6 = 4 then 'docx' else 'zip' end as type from documents""")
def zip_rules(spark, sf_dir):
    return analyze.assess(X.zips(spark, sf_dir)).select("blob_id", "risk_score", "scan_complete", "detection.type")


@query(f"""select doc_id as blob_id, 'f' || doc_id as name, cast(strlen(text) as bigint) as size, case when doc_id % 7 = 0 then 'encrypted' when strlen(text) > 65536 then 'not inspected' else 'text or unrecognised' end as detected,
      case when doc_id % 7 = 0 then 'cannot inspect' when strlen(text) > 65536 then 'not scanned' else 'no signature-level threat' end as risk, null as note from documents where doc_id % 6 <> 4
    union all select doc_id, {_EXTRA}, 0, 'text or unrecognised', 'no signature-level threat', case when doc_id % 6 = 1 then 'high-risk extension' end from documents where {_EXTRA} <> '' and doc_id % 6 <> 4""")
def archive_children(spark, sf_dir):
    d = extract.with_extraction(detect.with_detection(X.zips(spark, sf_dir))).filter("detection.type = 'zip'")
    # explode() would be planned with a filter on the children's number, for which every file is read a second time.
    return d.select("blob_id", F.explode_outer("extraction.children").alias("c")).filter("c is not null").select("blob_id", "c.*")


@query("select doc_id as blob_id, 'T' || doc_id as title, 'id ' || doc_id || chr(10) || 'two parts' as text, '1' as pages from documents")
def pdf_text(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    body = F.concat(F.lit("%PDF-1.4\n<< /Type /Page /Title (T"), key, F.lit(") >>\nBT (id "), key, F.lit(") Tj [(two) ( parts)] TJ ET\n"))
    e = extract.with_extraction(detect.with_detection(X.source.from_table(d, "doc_id", F.lit("a.pdf"), body)))
    return e.select("blob_id", e["extraction.metadata"]["Title"].alias("title"), "extraction.text", e["extraction.stats"]["Pages"].alias("pages"))


@query("select doc_id as blob_id, (['png', 'gif'])[doc_id % 2 + 1] as type, doc_id % 65000 + 1 as width, doc_id % 65000 + 7 as height from documents")
def image_dims(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    w, h = F.col("doc_id") % 65000 + 1, F.col("doc_id") % 65000 + 7
    png = F.concat(F.lit(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"), X.be(w, 4), X.be(h, 4), F.lit(b"\x08\x02\0\0\0"))
    gif = F.concat(F.lit(b"GIF89a"), X.le(w, 2), X.le(h, 2), F.lit(b"\0\0\0"))
    e = extract.with_extraction(detect.with_detection(X.source.from_table(d, "doc_id", F.lit("a"), F.when(F.col("doc_id") % 2 == 0, png).otherwise(gif))))
    m = e["extraction.metadata"]
    return e.select("blob_id", "detection.type", m["Width"].cast("long").alias("width"), m["Height"].cast("long").alias("height"))


@query("select doc_id as blob_id, (8000 + doc_id) || ' Hz' as sample_rate, '16' as depth, '2.0 s' as duration from documents")
def wav_info(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    fmt = F.concat(F.lit(b"\1\0\2\0"), X.le(F.col("doc_id") + 8000, 4), X.le(F.lit(100), 4), F.lit(b"\4\0\x10\0"))
    data = F.concat(F.lit(b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0"), fmt, F.lit(b"data\0\0\0\0" + bytes(200)))
    e = extract.with_extraction(detect.with_detection(X.source.from_table(d, "doc_id", F.lit("a.wav"), data)))
    m = e["extraction.metadata"]
    return e.select("blob_id", m["Sample rate"].alias("sample_rate"), m["Bit depth"].alias("depth"), m["Approx. duration"].alias("duration"))


@query("select doc_id as blob_id, (['x86-64', 'ARM64', 'ARM'])[doc_id % 3 + 1] as architecture, 's' || doc_id % 100 as section, cast(doc_id as varchar) as raw_size, 'execute/read' as permissions from documents")
def pe_sections(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    machine = F.unhex(X.pick(["6486", "64AA", "C001"], F.col("doc_id")))
    name = F.unhex(F.rpad(F.hex(F.encode(F.concat(F.lit("s"), (F.col("doc_id") % 100).cast("string")), "UTF-8")), 16, "0"))
    section = F.concat(name, X.le(F.lit(4096), 4), F.lit(bytes(4)), X.le(F.col("doc_id"), 4), F.lit(bytes(16)), F.lit(b"\x20\0\0\x60"))
    data = F.concat(F.lit(b"MZ" + bytes(58) + b"\x40\0\0\0PE\0\0"), machine, F.lit(b"\1\0" + bytes(16)), section, F.lit(b"tail"))
    e = extract.with_extraction(detect.with_detection(X.source.from_table(d, "doc_id", F.lit("a.exe"), data)))
    row = e["extraction.tables"][0]["rows"][0]
    return e.select("blob_id", e["extraction.metadata"]["Architecture"].alias("architecture"), row[0].alias("section"), row[2].alias("raw_size"), row[3].alias("permissions"))
