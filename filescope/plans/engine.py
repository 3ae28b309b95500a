"""Queries over what the engine itself writes, and over extractors, rules and containers that the catalogue's do not reach."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from filescope.functions import registry as R
from filescope.operators import analyze, catalog, delimited, detect, extract, prompts
from filescope.plans import fixtures as X
from filescope.plans.catalogue import _ALERTS, _FORGED_EXT, _FORGED_RISK, _PAGE_SCORE, _STRIPPED, _URLS, ORACLE, QUERIES, _level, query
from filescope.streaming import stream

__all__ = ["ORACLE", "QUERIES"]

# --- from analysis to the catalogue ---------------------------------

_USER_OF, _TIME_OF = "'u' || (blob_id % 7)", "timestamp '2026-01-01 00:00:00' + to_seconds(blob_id)"
_SEP = "chr(31)"
_FILE_ID = f"sha256(concat_ws({_SEP}, {_USER_OF}, sha256(content), file_name))"


def _stored(blobs):
    """(reports, user, time) of assessed blobs, as a user's uploads."""
    key = F.col("blob_id")
    return F.concat(F.lit("u"), (key % 7).cast("string")), F.timestamp_seconds(F.lit(1_767_225_600) + key)


def _files(spark, sf_dir):
    reports = analyze.assess(X.forged(spark, sf_dir))
    return catalog.files_table(reports, *_stored(reports))


_FILES = f"""with {_FORGED_RISK}, files as (select {_FILE_ID} as id, {_USER_OF} as user_id, file_name as original_name, octet_length(content) as size, sha256(content) as sha256, type as detected_type, mime as mime_type, confidence,
    match as extension_match, cast(score as integer) as risk_score, case when broken then 'UNKNOWN' else {_level("score")} end as risk_level, case when broken then 'scan_incomplete' else 'complete' end as status, {_TIME_OF} as created_at from scored)"""


@query(f"{_FILES} select * from files")
def files_from_analysis(spark, sf_dir):
    return _files(spark, sf_dir).select("id", "user_id", "original_name", "size", "sha256", "detected_type", "mime_type", "confidence", "extension_match", "risk_score", "risk_level", "status", "created_at")


def _forged_findings_sql() -> str:
    """Findings of the forged blobs, with their rank in the engine's order."""
    parts = [f"select blob_id, {i} as rank, '{r.category}' as category, '{r.severity}' as severity, {r.points} as points from judged where regexp_matches(file_name, '{r.pattern}')" for i, r in enumerate(R.NAME_RULES)]
    binary, run = "category = 'binary'", ", ".join(f"'{t}'" for t in R.RUNNABLE_TYPES)
    parts += [
        f"select blob_id, 10, 'Extension mismatch', case when {binary} then 'critical' else 'medium' end, case when {binary} then 45 else 18 end from judged where match = false",
        "select blob_id, 11, 'Extension', 'low', 5 from judged where match is null",
        f"select blob_id, 12, 'Executable content', case when type in ({run}) then 'high' else 'medium' end, case when type in ({run}) then 40 else 20 end from judged where {binary} or ext in ({', '.join(f"'{e}'" for e in R.EXECUTABLE)})",
        "select blob_id, 90, 'Scan error', 'medium', 10 from judged where broken",
    ]
    some = " union all ".join(parts)
    return f"found as ({some}), everything as (select * from found union all select blob_id, 0, 'Baseline', 'info', 0 from judged where blob_id not in (select blob_id from found))"


_FINDINGS = f"with {_FORGED_EXT}, {_forged_findings_sql()}"


@query(f"{_FINDINGS} select {_FILE_ID} as file_id, cast(row_number() over (partition by blob_id order by rank) - 1 as integer) as position, e.category, severity, points from everything e join judged using (blob_id)".replace("e.category", "e.category as category"))
def findings_from_analysis(spark, sf_dir):
    reports = analyze.assess(X.forged(spark, sf_dir))
    return catalog.findings_table(reports, *_stored(reports)).select("file_id", "position", "category", "severity", "points")


@query(f"{_FILES}, latest as (select * from files where user_id = 'u3' order by created_at desc, id limit 200) select count(*) as total, count(*) filter (risk_level in ('SAFE', 'LOW')) as safe, count(*) filter (risk_level = 'MEDIUM') as suspicious, count(*) filter (risk_level = 'HIGH') as high, count(*) filter (risk_level = 'CRITICAL') as critical from latest")
def dashboard_from_analysis(spark, sf_dir):
    return catalog.dashboard_counts(catalog.visible(_files(spark, sf_dir), "u3"))


@query(f"{_FILES} select id, original_name, risk_score, risk_level from files where risk_level in ({_ALERTS}) order by risk_score desc, id limit 200")
def alerts_from_analysis(spark, sf_dir):
    return catalog.alerts(_files(spark, sf_dir)).select("id", "original_name", "risk_score", "risk_level")


_PAGE_ROWS = "p as (select *, page_id as blob_id, 'page_' || page_id || '.html' as file_name, html as content from pages)"
_TRIMMED = f"trim({_STRIPPED}, ' ' || chr(9) || chr(10) || chr(13))"


@query(
    f"""with {_PAGE_ROWS} select {_FILE_ID} as file_id, sha256(concat_ws({_SEP}, {_FILE_ID}, 'analysis')) as id, md5({_TRIMMED}[1:{R.MAX_TEXT}]) as text_md5, length({_TRIMMED}) > {R.MAX_TEXT} as truncated,
      trim(regexp_extract(html, '(?i)<title[^>]*>([^<]{{1,200}})</title>', 1)) as title, cast(len(regexp_extract_all(html, '(?i)<([a-z][\\w:-]*)')) as varchar) as elements, cast(len(regexp_extract_all(html, '(?i)href\\s*=\\s*[\\x22\\x27][^\\x22\\x27]+')) as varchar) as links,
      cast(len(string_split_regex(html, '\\r?\\n')) as varchar) as lines, cast(len(regexp_extract_all(html, '[^\\s\\x0B]+')) as varchar) as words, 'Textual content matched a structural pattern' as evidence,
      rtrim(regexp_replace(hex(encode(html))[1:32], '(..)', '\\1 ', 'g')) as header_hex, {_TIME_OF} as created_at from p"""
)
def analyses_from_analysis(spark, sf_dir):
    """The analyses table of all pages, which also shows what the extractor makes of markup."""
    reports = analyze.analyze(X.pages(spark, sf_dir))
    a = catalog.analyses_table(reports, *_stored(reports))
    stats, told = a["metadata.stats"], a["metadata.metadata"]
    content = F.col("extracted_content")
    return a.select(
        "file_id", "id", F.md5(content["text"]).alias("text_md5"), content["truncated"].alias("truncated"), told["Title"].alias("title"), stats["Elements"].alias("elements"), stats["Links"].alias("links"),
        stats["Lines"].alias("lines"), stats["Words"].alias("words"), F.array_join("metadata.evidence", "; ").alias("evidence"), a["metadata.headerHex"].alias("header_hex"), "created_at",
    )


@query("select doc_id as blob_id, case when doc_id % 500 = 0 then 52428801 else octet_length(encode(text)) end as size, doc_id % 500 <> 0 as kept, doc_id % 500 = 0 as unknown from documents")
def size_gate(spark, sf_dir):
    """Every 500th blob is one byte too large: it stays a row, without content and with an incomplete scan."""
    d = X.table(spark, sf_dir, "documents")
    over = F.col("doc_id") % 500
    # How often depends on the row, so that the planner does not make the large value itself and send it along with each task.
    data = F.when(over == 0, F.repeat(F.lit("x"), (over + 52_428_801).cast("int")).cast("binary")).otherwise(F.encode("text", "UTF-8"))
    found = analyze.assess(X.source.from_table(d, "doc_id", F.lit("a.bin"), data))
    return found.select("blob_id", "size", F.col("content").isNotNull().alias("kept"), (F.col("risk_level") == "UNKNOWN").alias("unknown"))


@query(f"select cast(timestamp '1970-01-01 00:00:00' + to_seconds(page_id * 3600) as date) as day, {_level(_PAGE_SCORE)} as risk_level, count(*) as n from pages group by all")
def stream_trend(spark, sf_dir):
    """Pages as files that arrive one an hour: a bounded stream of all of them, counted by day and level."""
    files = spark.readStream.schema(X.table(spark, sf_dir, "pages").schema).parquet(f"{sf_dir}/page[s].parquet")
    blobs = X.source.from_table(files, "page_id", F.concat(F.lit("page_"), "page_id", F.lit(".html")), F.col("html"))
    counted = stream.trend(analyze.assess(blobs.withColumn("arrived", F.timestamp_seconds(F.col("blob_id") * 3600))))
    found = stream.bounded(counted, "complete")
    return found.select(F.to_date("window.start").alias("day"), "risk_level", F.col("count").alias("n"))


@query("select cast(conv_id as varchar) as file_id, role, sha256(concat_ws(chr(31), cast(conv_id as varchar), role, cast(turn as varchar), text)) as id, text as content, turn as created_at from conversations where role in ('user', 'assistant')")
def chat_inserts(spark, sf_dir):
    said = X.messages(spark, sf_dir).drop("id")
    rows = [catalog.messages_table(said.filter(F.col("role") == r).drop("role").withColumnRenamed("content", "said"), r, F.col("said"), F.col("created_at")) for r in ("user", "assistant")]
    return rows[0].unionByName(rows[1]).select("file_id", "role", "id", "content", "created_at")


@query(f"with {X.CATALOGUE_SQL} select id, (select arg_max(text, turn) from conversations where cast(conv_id as varchar) = id) as summary from f")
def latest_summaries(spark, sf_dir):
    """Each file with the last of its summaries, for which the turns of conversations stand in."""
    m = X.messages(spark, sf_dir)
    r = catalog.report(X.catalogue(spark, sf_dir), X.findings(spark, sf_dir).limit(0), m.limit(0), m.select("file_id", F.col("content").alias("summary"), "created_at"))
    return r.select("id", "summary")


@query(f"with {X.CATALOGUE_SQL} select id, detected_type, risk_level from f where id = '5'")
def point_lookup(spark, sf_dir):
    return catalog.only(X.catalogue(spark, sf_dir).select("id", "detected_type", "risk_level"), F.col("id") == "5")


@query(
    f"""with {X.CATALOGUE_SQL}, m as (select cast(conv_id as varchar) as file_id, turn, '<' || role || '>' || chr(10) || text as said, row_number() over (partition by conv_id order by turn desc) as n from conversations), h as (select file_id, string_agg(said, chr(10) || chr(10) order by turn) as past from m where n <= 10 group by 1),
    t as (select f.*, d.text, h.past from f join documents d on cast(d.doc_id as varchar) = f.id left join h on h.file_id = f.id)
    select id, md5(concat_ws(chr(10) || chr(10), '<system>' || chr(10) || '{prompts.QUESTION_SYSTEM.replace("'", "''")}', '<user>' || chr(10) || 'FILE: ' || id || ' (' || detected_type || ')' || chr(10) || 'SECURITY VERDICT (authoritative): ' || risk_level || chr(10) || '{prompts.BEGIN}' || chr(10) || coalesce(nullif(text[1:{prompts.CONTENT_LIMIT}], ''), '{prompts.NOTHING}') || chr(10) || '{prompts.STOP}', past, '<user>' || chr(10) || 'What is in ' || id || '?')) as prompt_md5,
      'No model is connected. The engine''s verdict is ' || risk_level || '.' as answer from t"""
)
def questions(spark, sf_dir):
    """A question about each file: its context, the last ten messages, and the answer of the offline provider."""
    past = catalog.last_messages(X.messages(spark, sf_dir), 10).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "role", "content"))).alias("past"))
    d = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text")
    j = X.catalogue(spark, sf_dir).join(d, F.col("id") == F.col("_id")).join(past, F.col("id") == F.col("file_id"), "left")
    history = F.coalesce(F.transform("past", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), F.expr("cast(array() as array<struct<role:string,content:string>>)"))
    context = prompts.question_context(F.col("id"), F.col("detected_type"), F.col("risk_level"), F.col("text"))
    asked = j.select("id", prompts.question_prompt(context, history, F.concat(F.lit("What is in "), "id", F.lit("?"))).alias("prompt"))
    return prompts.with_answer(asked).select("id", F.md5("prompt").alias("prompt_md5"), "answer")


@query("select doc_id, case when doc_id % 3 = 2 then 'No JSON here, ' || doc_id else 'd' || doc_id end as one_liner, case when doc_id % 3 = 2 then '' else 'k' end as key_points from documents")
def fenced_answers(spark, sf_dir):
    """Answers of a model that are fenced, bare, or no JSON at all."""
    one = F.concat(F.lit('{"oneLiner": "d'), F.col("doc_id"), F.lit('", "keyPoints": ["k", 7], "topics": 3}'))
    key = F.col("doc_id") % 3
    raw = F.when(key == 0, F.concat(F.lit("Here:\n```json\n"), one, F.lit("\n```\nDone {x}"))).when(key == 1, F.concat(F.lit("Sure. "), one)).otherwise(F.concat(F.lit("No JSON here, "), F.col("doc_id")))
    read = F.pandas_udf(lambda s: pd.DataFrame([(a["oneLiner"], "".join(a["keyPoints"])) for a in map(prompts.read_answer, s)], columns=["one_liner", "key_points"]), "one_liner string, key_points string")
    return X.table(spark, sf_dir, "documents").select("doc_id", read(raw).alias("a")).select("doc_id", "a.*")


# --- rules that other queries do not fire ---------------------------

_NAMES = ["report.txt", "a‮fdp.txt", "KeyGen.txt", "dispatch.txt", "loader_‮gnp.txt", "plain"]


@query(f"select doc_id as blob_id, name as file_name, trim({' || '.join(f'case when regexp_matches(name, {chr(39)}{r.pattern}{chr(39)}) then {chr(39)}{r.description}; {chr(39)} else {chr(39)}{chr(39)} end' for r in R.NAME_RULES)}) as fired from (select doc_id, {X.pick_sql(_NAMES, 'doc_id')} as name from documents)")
def name_findings(spark, sf_dir):
    found = analyze.assess(X.source.from_table(X.table(spark, sf_dir, "documents"), "doc_id", X.pick(_NAMES, F.col("doc_id")), F.col("text")))
    fired = F.transform(F.filter("findings", lambda f: f["category"] == "Filename"), lambda f: F.concat(f["description"], F.lit(";")))
    return found.select("blob_id", "file_name", F.array_join(fired, " ").alias("fired"))


@query("select doc_id as blob_id, 'unknown' as type, 'UNKNOWN' as risk_level, case when doc_id % 2 = 0 then 29 else 15 end as risk_score, case when doc_id % 2 = 0 then 'Entropy, ' else '' end || 'Unrecognised format' as fired from documents")
def unknown_rules(spark, sf_dir):
    """Blobs without a signature that are no text: half of them of high entropy."""
    d = X.table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    dense = F.unhex(F.concat(F.lit("00FE"), *(F.sha2(F.concat(key, F.lit(f"-{i}")), 256) for i in range(80))))
    data = F.when(F.col("doc_id") % 2 == 0, dense).otherwise(F.concat(F.lit(b"\0\xfe"), F.encode("text", "UTF-8")))
    found = analyze.assess(X.source.from_table(d, "doc_id", F.lit("a.bin"), data))
    return found.select("blob_id", "detection.type", "risk_level", "risk_score", F.array_join(F.transform("findings", lambda f: f["category"]), ", ").alias("fired"))


_CELLS = ["=cmd|calc", "-1", "@x", "+2", "fine", "a=b"]


@query(f"select doc_id as blob_id, 'csv' as type, case when regexp_matches(cell, '^[=+\\-@]') then (cell || ',2')[1:61] end as evidence from (select doc_id, {X.pick_sql(_CELLS, 'doc_id')} as cell from documents)")
def csv_injection_findings(spark, sf_dir):
    text = F.concat(F.lit("name,n\n"), X.pick(_CELLS, F.col("doc_id")), F.lit(",2\nlast,3\n"))
    found = analyze.assess(X.source.from_table(X.table(spark, sf_dir, "documents"), "doc_id", F.lit("a.csv"), text))
    hit = F.get(F.filter("findings", lambda f: f["category"] == "CSV injection"), F.lit(0))
    return found.select("blob_id", "detection.type", hit["evidence"].alias("evidence"))


def _more_zips(spark, sf_dir):
    """Archives that swell, that have very many entries (every 40th), that fetch a template, and a plain one."""

    def packed(key: int) -> bytes:
        if key % 40 == 1:
            return X.container({f"f{i}": b"" for i in range(1001)})
        if key % 4 == 0:
            return X.container({"big.txt": b"x"}, declared=60_000_000)
        if key % 4 == 2:
            return X.container({"word/document.xml": b"<w:p/>", "word/_rels/settings.xml.rels": b'<Relationship Type="attachedTemplate" Target="http://t.example/a.dotm"/>'})
        return X.container({"a.txt": b"x"})

    make = F.pandas_udf(lambda s: s.map(packed), "binary")
    return X.source.from_table(X.table(spark, sf_dir, "documents"), "doc_id", F.when(F.col("doc_id") % 4 == 2, "a.docx").otherwise("a.zip"), make("doc_id"))


@query(
    """select doc_id as blob_id, case when doc_id % 40 = 1 then 'Archive structure: 1001 entries' when doc_id % 4 = 0 then 'Decompression bomb: Ratio ≈ ' || cast(floor(60000000 / n + 0.5) as bigint) || ':1 (60 MB expanded)' when doc_id % 4 = 2 then 'Remote content: Target="http://t.example/a.dotm"' else 'Baseline: ZIP Archive' end as fired,
      case when doc_id % 40 = 1 then 6 when doc_id % 4 = 0 then 45 when doc_id % 4 = 2 then 30 else 0 end as risk_score, case when doc_id % 4 = 2 then 'docx' else 'zip' end as type from (select doc_id, 30 + 46 + 22 + 2 * 7 + 1 as n from documents)"""
)
def zip_rules_more(spark, sf_dir):
    found = analyze.assess(_more_zips(spark, sf_dir))
    first = F.get("findings", F.lit(0))
    return found.select("blob_id", F.concat(first["category"], F.lit(": "), F.split(first["evidence"], " · ")[0]).alias("fired"), "risk_score", "detection.type")


_SEVERITY = " || ".join(f"case when regexp_matches(html, '{r.pattern}') then '[{r.severity}] {r.description}; ' else '' end" for r in R.SCRIPT_RULES)


@query(
    f"""with s as (select *, least(100, {" + ".join(f"case when regexp_matches(html, '{r.pattern}') then {r.points} else 0 end" for r in R.SCRIPT_RULES)} + case when {_URLS} > 0 then 12 else 0 end) as score,
      {_SEVERITY} || case when {_URLS} > 0 then '[medium] ' || {_URLS} || ' suspicious URL(s) found (raw IP, shortener or high-abuse TLD); ' else '' end as found from pages)
    select page_id as blob_id, 'page_' || page_id || '.html: html' as "oneLiner", 'Verdict ' || {_level("score")} || ' · score ' || score || '/100.' as detailed,
      coalesce(nullif(rtrim(rtrim(found), ';'), ''), '[info] No security rule triggered during static analysis') as "securityExplanation" from s"""
)
def page_summaries(spark, sf_dir):
    """Prompts of the pages' analyses, answered by the offline provider."""
    a = analyze.analyze(X.pages(spark, sf_dir))
    e = F.col("extraction")
    prompt = prompts.summary_prompt(F.col("file_name"), F.col("detection.type"), F.col("extension_match"), F.col("risk_level"), F.col("risk_score"), F.col("findings"), e["notes"], F.to_json(e["stats"]), F.to_json(e["metadata"]), e["text"])
    return prompts.with_summary(a.select("blob_id", prompt.alias("prompt"))).select("blob_id", "summary.oneLiner", "summary.detailed", "summary.securityExplanation")


_SILENT = "'rar', '7z', 'gz', 'bz2', 'xz', 'tar', 'zstd', 'ole'"


@query(
    f"""with {_FORGED_RISK}, n as (select blob_id, count(*) as n from (select * from ({_FINDINGS} select * from everything)) group by 1)
    select s.blob_id, file_name, sha256(content) as sha256, type, cast(score as integer) as risk_score, case when broken then 'UNKNOWN' else {_level("score")} end as risk_level, cast(n.n as integer) as n_findings,
      broken or category in ('audio', 'video') or type in ({_SILENT}) as unsupported, case when broken then 'ZIP end-of-central-directory record not found' end as error from scored s join n using (blob_id)"""
)
def full_analysis(spark, sf_dir):
    """Everything at once over all forged blobs, content included."""
    a = analyze.analyze(X.forged(spark, sf_dir))
    return a.select("blob_id", "file_name", "sha256", "detection.type", "risk_score", "risk_level", F.size("findings").alias("n_findings"), "extraction.unsupported", "extraction.error")


# --- types by probes ------------------------------------------------


@query("select doc_id as blob_id, case when doc_id % 100 = 0 then 'txt' else 'script' end as type from documents")
def probe_window(spark, sf_dir):
    """A line that makes text a script counts in the first 262,144 bytes only: every hundredth has it after them."""
    filler = F.repeat(F.lit("word "), F.when(F.col("doc_id") % 100 == 0, F.lit(52_430)).otherwise(F.lit(50_000) - F.col("doc_id") % 100 * 500).cast("int"))
    text = F.concat(filler, F.lit("\nimport x\n"))
    return detect.with_detection(X.source.from_table(X.table(spark, sf_dir, "documents"), "doc_id", F.lit("a"), text)).select("blob_id", "detection.type")


def _delimited_sql(mark: str) -> str:
    counts = f"list_distinct(list_transform(lines, lambda x: length(x) - length(replace(x, {mark}, ''))))"
    return f"len(lines) >= 2 and len({counts}) = 1 and {counts}[1] >= 1"


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""with t as (select doc_id, chr(10) || 'plain ' || text as t from documents), l as (select *, list_filter(string_split_regex(t, '\\r?\\n'), lambda x: trim(x, {_BLANK}) <> '')[1:20] as lines from t)
    select doc_id as blob_id, case when regexp_matches(t, '(?m)^\\s*(import |from |def |function |const |package |#include)') then 'script' when regexp_matches(t, '\\A\\s{{0,3}}#{{1,6}}\\s|\\n\\s{{0,3}}#{{1,6}}\\s|\\[[^\\]]+\\]\\([^)]+\\)') then 'markdown'
      when {_delimited_sql("','")} then 'csv' when {_delimited_sql("chr(9)")} then 'tsv' when {_delimited_sql("';'")} then 'csv' else 'txt' end as type from l"""
)
def plain_text(spark, sf_dir):
    text = F.concat(F.lit("\nplain "), "text")
    return detect.with_detection(X.source.from_table(X.table(spark, sf_dir, "documents"), "doc_id", F.lit("a"), text)).select("blob_id", "detection.type")


# --- extractors -----------------------------------------------------


def _extracted(blobs):
    return extract.with_extraction(detect.with_detection(blobs))


def _office(spark, sf_dir, make, ext: str):
    """An office document for each row of documents, packed and deflated by `make(id, text)`."""
    packed = F.pandas_udf(lambda n, t: pd.Series([X.container(make(*r), deflated=True) for r in zip(n, t, strict=True)]), "binary")
    return _extracted(X.source.from_table(X.table(spark, sf_dir, "documents"), "doc_id", F.lit(f"a.{ext}"), packed("doc_id", "text")))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _docx(key: int, text: str) -> dict[str, bytes]:
    lines = "".join(f'<w:p w:rsidR="1"><w:r><w:t>{_escaped(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    body = f'<w:document><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Doc {key}</w:t></w:r></w:p>{lines}</w:body></w:document>'
    core = f"<cp:coreProperties><dc:title>Title {key}</dc:title><dc:creator>A. Uthor</dc:creator></cp:coreProperties>"
    rels = f'<Relationships><Relationship Target="https://x.example/{key}"/><Relationship Target="styles.xml"/></Relationships>'
    return {"[Content_Types].xml": b"<Types/>", "word/document.xml": body.encode(), "docProps/core.xml": core.encode(), "docProps/app.xml": f"<Properties><Pages>{key % 9 + 1}</Pages></Properties>".encode(), "word/_rels/document.xml.rels": rels.encode()}


_DOCX_TEXT = "'  ' || chr(10) || '    Doc ' || doc_id || '  ' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: chr(10) || '  ' || x || '  ' || chr(10)), '') || '  '"
_DOCX_PLAIN = f"regexp_replace(regexp_replace({_DOCX_TEXT}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') || chr(10)"


@query(
    f"""with d as (select doc_id, {_DOCX_PLAIN} as raw from documents), c as (select *, trim(regexp_replace(raw, '[ \\t]+\\n', chr(10), 'g'), {_BLANK}) as plain from d)
    select doc_id as blob_id, 'docx' as type, 'Title ' || doc_id as title, 'A. Uthor' as creator, cast(doc_id % 9 + 1 as varchar) as pages, 'Doc ' || doc_id as heading, 'https://x.example/' || doc_id as link,
      cast(len(regexp_extract_all(raw, '[^\\s\\x0B]+')) as varchar) as words, cast(len(list_filter(string_split(raw, chr(10)), lambda x: trim(x, {_BLANK}) <> '')) as varchar) as paragraphs, md5(plain[1:{R.MAX_TEXT}]) as text_md5, length(plain) > {R.MAX_TEXT} as truncated from c"""
)
def office_docx(spark, sf_dir):
    e = _office(spark, sf_dir, _docx, "docx")
    m, s, t = e["extraction.metadata"], e["extraction.stats"], e["extraction.tables"]
    return e.select("blob_id", "detection.type", m["title"].alias("title"), m["creator"].alias("creator"), m["Pages"].alias("pages"), t[0]["rows"][0][0].alias("heading"), t[1]["rows"][0][0].alias("link"), s["Words"].alias("words"), s["Paragraphs"].alias("paragraphs"), F.md5("extraction.text").alias("text_md5"), "extraction.truncated")


def _xlsx(key: int, text: str) -> dict[str, bytes]:
    shared = "".join(f"<si><t>{x}</t></si>" for x in ("Name", "Id &amp; more", f"n{key}"))
    rows = [
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>',
        f'<row r="2"><c r="A2" t="s"><v>2</v></c><c r="C2"><f>1+1</f><v>{key}</v></c><c r="AA2" t="inlineStr"><is><t>far</t></is></c></row>',
        *(f'<row r="{i}"><c r="B{i}"><v>{i}</v></c></row>' for i in range(3, 3 + key % 60)),
    ]
    sheet = f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>"
    return {"[Content_Types].xml": b"<Types/>", "xl/workbook.xml": b'<workbook><sheets><sheet name="First" sheetId="1"/><sheet name="Other" sheetId="2"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst>{shared}</sst>".encode(), "xl/worksheets/sheet1.xml": sheet.encode()}


@query(
    f"""select doc_id as blob_id, 'xlsx' as type, 'First, Other' as sheet_names, '2' as sheets, cast(2 + doc_id % 60 as varchar) as n_rows, '1' as formulas, 'First' as table_name, 'Name|col_2|Id & more' as columns, doc_id % 60 > 38 as table_truncated,
      md5('[First]' || chr(10) || 'Name |  | Id & more' || chr(10) || 'n' || doc_id || ' |  | ' || doc_id || repeat(' | ', 24) || 'far' || coalesce(array_to_string(list_transform(range(3, 3 + least(doc_id % 60, 38)), lambda i: chr(10) || ' | ' || i), ''), '')) as text_md5 from documents"""
)
def office_xlsx(spark, sf_dir):
    e = _office(spark, sf_dir, _xlsx, "xlsx")
    s, t = e["extraction.stats"], e["extraction.tables"][0]
    return e.select(
        "blob_id", "detection.type", e["extraction.metadata"]["Sheet names"].alias("sheet_names"), s["Sheets"].alias("sheets"), s["Rows (sampled sheets)"].alias("n_rows"), s["Formulas"].alias("formulas"),
        t["name"].alias("table_name"), F.array_join(t["columns"], "|").alias("columns"), t["truncated"].alias("table_truncated"), F.md5("extraction.text").alias("text_md5"),
    )


def _pptx(key: int, text: str) -> dict[str, bytes]:
    slide = lambda s: f"<p:sld><a:p><a:r><a:t>{s}</a:t></a:r></a:p></p:sld>".encode()
    parts = {f"ppt/slides/slide{i}.xml": slide(f"Page {i} of {key}") for i in range(1, 2 + key % 3)}
    return {"[Content_Types].xml": b"<Types/>", **parts, "ppt/notesSlides/notesSlide1.xml": slide("Say &quot;this&quot;"), "ppt/media/a.png": b"x"}


@query(
    """select doc_id as blob_id, 'pptx' as type, cast(1 + doc_id % 3 as varchar) as slides, '1' as media,
      array_to_string(list_transform(range(1, 2 + doc_id % 3), lambda i: '[Slide ' || i || ']' || chr(10) || 'Page ' || i || ' of ' || doc_id), chr(10) || chr(10)) || chr(10) || chr(10) || '[Speaker notes 1]' || chr(10) || 'Say "this"' as text from documents"""
)
def office_pptx(spark, sf_dir):
    e = _office(spark, sf_dir, _pptx, "pptx")
    s = e["extraction.stats"]
    return e.select("blob_id", "detection.type", s["Slides"].alias("slides"), s["Embedded media"].alias("media"), "extraction.text")


@query(
    """select c_custkey as blob_id, (['csv', 'tsv', 'csv'])[c_custkey % 3 + 1] as type, ([',', 'tab', ';'])[c_custkey % 3 + 1] as delimiter, '3' as n_rows, '3' as n_columns, 'name: text, 0 missing, 3 distinct; column_2: integer, 1 missing, min 0 · max ' || c_custkey || ' · avg ' || printf('%.2f', (c_custkey + c_custkey // 2) / 3.0) || '; when: date, 0 missing, 2 distinct' as profile,
      c_name || ' | ' || c_custkey || ' | 2024-01-02' as first_row from customer"""
)
def delimited_extract(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    mark = X.pick([",", "\t", ";"], F.col("c_custkey"))
    line = lambda *cells: F.concat_ws("", *(x for cell in cells for x in (mark, cell)))
    n = F.col("c_custkey")
    rows = [line(F.lit("name"), F.lit(""), F.lit("when")), line(F.col("c_name"), n.cast("string"), F.lit("2024-01-02")), line(F.concat(F.lit('"a ""b""'), mark, F.lit(' c"')), F.lit(" "), F.lit("2024-02-03")), line(F.lit("z"), F.floor(n / 2).cast("string"), F.lit("2024-02-03"))]
    text = F.concat_ws("\n", *(F.substring(r, 2, 1 << 20) for r in rows))
    e = delimited.extract(c.select(n.alias("blob_id"), F.encode(text, "UTF-8").alias("content"), F.struct(X.pick(["csv", "tsv", "csv"], n).alias("type"), F.lit("x").alias("label"), F.lit("data").alias("category"), F.lit(None).cast("string").alias("container")).alias("detection")))
    s, t = e["extraction.stats"], e["extraction.tables"]
    profile = F.array_join(F.transform(t[0]["rows"], lambda r: F.concat(r[0], F.lit(": "), r[1], F.lit(", "), r[2], F.lit(" missing, "), r[3])), "; ")
    return e.select("blob_id", "detection.type", s["Delimiter"].alias("delimiter"), s["Rows"].alias("n_rows"), s["Columns"].alias("n_columns"), profile.alias("profile"), F.array_join(t[1]["rows"][0], " | ").alias("first_row"))


_TEXTS = ["select 1;;\ncreate table t (x); ", "{\\rtf1\\b Bold\\'e9 ", "<?xml version='1.0'?><title>T</title><script>x</script><a href='u'>", '[{"a": 1, "b": [true], "c": {"d": "x", "e": null}}, 2]', '{"a": 1}\n{"b": []}\n{"c": "']


@query(
    """select doc_id as blob_id, (['sql', 'rtf', 'xml', 'json', 'jsonl'])[doc_id % 5 + 1] as type, ([ 'create table t', null, 'T', 'array[2] of { a: number, b: array[1] of boolean, c: { d: string, e: object } }', 'array[3] of { a: number }'])[doc_id % 5 + 1] as told,
      (['3', null, '4', '2', '3'])[doc_id % 5 + 1] as counted, case doc_id % 5 when 0 then 'select 1;;' || chr(10) || 'create table t (x);  -- ' || doc_id when 1 then 'Bold ' || doc_id || ' end' when 2 then 'T ' || doc_id || ' b'
      when 3 then '[{"a": 1, "b": [true], "c": {"d": "x", "e": null}}, 2]' else '{"a": 1}' || chr(10) || '{"b": []}' || chr(10) || '{"c": "' || doc_id || '"}' end as text from documents"""
)
def structured_extract(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    tails = [F.concat(F.lit(" -- "), key), F.concat(key, F.lit("\\par end}")), F.concat(key, F.lit("</a><b>b</b>")), F.lit(""), F.concat(key, F.lit('"}'))]
    at = F.pmod(F.col("doc_id"), F.lit(5))
    tail = F.coalesce(*(F.when(at == i, t) for i, t in enumerate(tails)))
    e = _extracted(X.source.from_table(d, "doc_id", F.lit("a"), F.concat(X.pick(_TEXTS, F.col("doc_id")), tail)))
    m, s = e["extraction.metadata"], e["extraction.stats"]
    return e.select("blob_id", "detection.type", F.coalesce(m["Tables created"], m["Title"], m["Schema"]).alias("told"), F.coalesce(s["Statements"], s["Elements"], s["Records"]).alias("counted"), "extraction.text")


@query(
    """select doc_id as blob_id, (['elf', 'sqlite', 'class', 'wasm'])[doc_id % 4 + 1] as type, case doc_id % 4 when 0 then (['relocatable', 'executable', 'shared object', 'core dump', '5'])[doc_id % 5 + 1] || ', ' || (['x86-64', 'ARM', 'RISC-V', '0x1'])[doc_id // 4 % 4 + 1] || ', 64-bit, little'
      when 1 then case when doc_id % 3 = 0 then 65536 else 4096 end || ', CREATE TABLE t' || doc_id || ' (x)' when 2 then (45 + doc_id % 20) || '.3' else cast(doc_id % 7 as varchar) end as facts from documents"""
)
def binary_facts(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    at = F.pmod(key, F.lit(4))
    one = lambda values, by: F.unhex(X.pick(values, by))
    elf = F.concat(F.lit(b"\x7fELF\x02\x01" + bytes(10)), one(["0100", "0200", "0300", "0400", "0500"], key), one(["3E00", "2800", "F300", "0100"], F.floor(key / 4)))
    sqlite = F.concat(F.lit(b"SQLite format 3\0"), one(["0000", "1000", "1000"], key), F.lit(b"\0"), F.encode(F.concat(F.lit("CREATE TABLE t"), key.cast("string"), F.lit("  (x)")), "UTF-8"), F.lit(b"\0"))
    code = F.concat(F.lit(b"\xca\xfe\xba\xbe\0\3"), X.be(F.lit(45) + key % 20, 2))
    wasm = F.concat(F.lit(b"\0asm"), X.le(key % 7, 4))
    data = F.when(at == 0, elf).when(at == 1, sqlite).when(at == 2, code).otherwise(wasm)
    e = _extracted(X.source.from_table(d, "doc_id", F.lit("a"), F.concat(data, F.lit(bytes(3)))))
    m = e["extraction.metadata"]
    ddl = F.get(F.get("extraction.tables", F.lit(0))["rows"], F.lit(0))[0]
    facts = F.coalesce(F.concat_ws(", ", m["Object type"], m["Architecture"], m["Class"], m["Endianness"]).alias("x"), F.lit(""))
    return e.select("blob_id", "detection.type", F.when(m["Object type"].isNotNull(), facts).when(m["Page size"].isNotNull(), F.concat_ws(", ", m["Page size"], ddl)).otherwise(F.coalesce(m["Class file version"], m["WASM version"])).alias("facts"))


_SUSPECT = "(?i)https?://|\\.dll\\z|\\.exe\\z|Advapi|kernel32|CreateProcess|VirtualAlloc|RegSet|cmd\\.exe|powershell|/bin/sh|socket|GetProcAddress"
_STRINGS = "regexp_extract_all(t, '[\\x20-\\x7e]{6,}')[1:400]"


@query(
    f"""with d as (select doc_id, text || chr(10) || (['plain words', 'see http://a.example', 'load KERNEL32.dll', 'a socket', 'run it.exe', 'not.exe.txt'])[doc_id % 6 + 1] as t from documents), s as (select doc_id, {_STRINGS} as s from d), n as (select *, list_filter(s, lambda x: regexp_matches(x, '{_SUSPECT}')) as n from s)
    select doc_id as blob_id, 'pe' as type, cast(len(s) as varchar) as n_strings, coalesce(array_to_string(list_transform(n, lambda x: x[1:200])[1:60], chr(10)), '') as notable, md5(array_to_string(s[1:200], chr(10))[1:20000]) as text_md5, len(s) > 200 as truncated from n"""
)
def notable_strings(spark, sf_dir):
    suffix = ["plain words", "see http://a.example", "load KERNEL32.dll", "a socket", "run it.exe", "not.exe.txt"]
    d = X.table(spark, sf_dir, "documents")
    body = F.concat(F.lit(b"MZ\0"), F.encode(F.concat("text", F.lit("\n"), X.pick(suffix, F.col("doc_id"))), "UTF-8"))
    e = _extracted(X.source.from_table(d, "doc_id", F.lit("a.exe"), body))
    rows = F.get("extraction.tables", F.lit(0))["rows"]
    return e.select("blob_id", "detection.type", e["extraction.stats"]["Extracted strings"].alias("n_strings"), F.coalesce(F.array_join(F.transform(rows, lambda r: r[0]), "\n"), F.lit("")).alias("notable"), F.md5("extraction.text").alias("text_md5"), "extraction.truncated")


@query("""select doc_id as blob_id, cast(len(s) as varchar) as n_strings, md5(array_to_string(s, chr(10))[1:8000]) as text_md5, true as unsupported from (select doc_id, regexp_extract_all(text, '[\\x20-\\x7e]{8,}')[1:120] as s from documents)""")
def unknown_extract(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    # Zeros beyond the last signature's place: after a single one, a text that begins with asm would be a WASM file.
    head = bytes(max(s.offset + len(s.pattern) // 2 for s in R.SIGNATURES))
    e = _extracted(X.source.from_table(d, "doc_id", F.lit("a.bin"), F.concat(F.lit(head), F.encode("text", "UTF-8"))))
    told = lambda c: F.when(F.col("content").isNotNull(), c)
    return e.select("blob_id", told(e["extraction.stats"]["Readable strings"]).alias("n_strings"), told(F.md5("extraction.text")).alias("text_md5"), "extraction.unsupported")


@query("select doc_id as blob_id, '2' as entries, printf('%.1f KB', floor((strlen(text) + 5) / 1024.0 * 10 + 0.5) / 10) as size, case when doc_id % 7 = 0 then '1' else '0' end as encrypted from documents")
def archive_stats(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    pack = F.pandas_udf(lambda n, t: pd.Series([X.stored_zip("f", x, "x", k % 7 == 0) for k, x in zip(n, t, strict=True)]), "binary")
    e = _extracted(X.source.from_table(d, "doc_id", F.lit("a.zip"), pack("doc_id", F.concat("text", F.lit("12345")))))
    s = F.col("extraction.stats")
    return e.select("blob_id", s["Entries"].alias("entries"), s["Uncompressed size"].alias("size"), s["Encrypted"].alias("encrypted"))


_PACKED = [("1F8B08", "GZIP Compressed Data"), ("425A68", "BZIP2 Compressed Data"), ("526172211A07", "RAR Archive"), ("377ABCAF271C", "7-Zip Archive")]


@query(
    f"""select doc_id as blob_id, {X.pick_sql([label for _, label in _PACKED], "doc_id")} as format, true as unsupported, printf('%.1f KB', floor((octet_length(encode(text)) + ([3, 3, 6, 6])[doc_id % 4 + 1]) / 1024.0 * 10 + 0.5) / 10) as size,
      {X.pick_sql([label for _, label in _PACKED], "doc_id")} || ' is not opened here: its entries are not listed.' as note from documents"""
)
def opaque_archives(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    head = F.unhex(X.pick([h for h, _ in _PACKED], F.col("doc_id")))
    e = _extracted(X.source.from_table(d, "doc_id", F.lit("a"), F.concat(head, F.encode("text", "UTF-8"))))
    return e.select("blob_id", e["extraction.metadata"]["Format"].alias("format"), "extraction.unsupported", e["extraction.stats"]["Compressed size"].alias("size"), F.get("extraction.notes", F.lit(0)).alias("note"))


@query("select doc_id as blob_id, 'jpeg' as type, cast(doc_id % 60000 + 1 as varchar) as width, cast(doc_id % 50000 + 2 as varchar) as height, '3' as components, 'Model: Camera ' || doc_id as embedded from documents")
def jpeg_facts(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    data = F.concat(F.lit(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08"), X.be(key % 50_000 + 2, 2), X.be(key % 60_000 + 1, 2), F.lit(b"\3" + bytes(9) + b"Model\0"), F.encode(F.concat(F.lit("Camera "), key.cast("string")), "UTF-8"), F.lit(bytes(2)))
    e = _extracted(X.source.from_table(d, "doc_id", F.lit("a.jpg"), data))
    m = e["extraction.metadata"]
    return e.select("blob_id", "detection.type", m["Width"].alias("width"), m["Height"].alias("height"), m["Components"].alias("components"), m["Embedded strings"].alias("embedded"))


@query("select doc_id as blob_id, 'Inflated ' || doc_id || chr(10) || 'again' as text, '1' as images, '1' as links, 'http://x.example/' || doc_id as first_link from documents")
def pdf_streams(spark, sf_dir):
    """PDF files whose text is in Flate streams, one of them broken."""

    def packed(key: int) -> bytes:
        stream = lambda x: b"<< /Filter /FlateDecode >>\nstream\n" + x + b"\nendstream\n"
        own = str(key).encode()
        return b"%PDF-1.4\n/URI (http://x.example/" + own + b") /Subtype /Image\n" + stream(zlib.compress(b"BT (Inflated " + own + b") Tj ET")) + stream(b"broken") + stream(zlib.compress(b"BT [(ag) -20 (ain)] TJ ET"))

    e = _extracted(X.source.from_table(X.table(spark, sf_dir, "documents"), "doc_id", F.lit("a.pdf"), F.pandas_udf(lambda s: s.map(packed), "binary")("doc_id")))
    s = e["extraction.stats"]
    return e.select("blob_id", "extraction.text", s["Embedded images"].alias("images"), s["Links"].alias("links"), e["extraction.tables"][0]["rows"][0][0].alias("first_link"))
