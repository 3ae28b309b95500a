"""Queries over rows that change, and over streams of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from filescope.operators import analyze, asking, catalog
from filescope.plans import engine
from filescope.plans import fixtures as X
from filescope.plans.catalogue import ORACLE, query
from filescope.sources import shared, store
from filescope.streaming import stream

# --- rows that change -----------------------------------------------


def _filled(spark, sf_dir) -> store.Store:
    """A store of the catalogue after uploads, changes, deletions, compaction, and files that come back."""
    s = store.Store(spark, shared.fresh(spark, "store"), buckets=8)
    key = F.col("id").cast("long")
    files = X.catalogue(spark, sf_dir).select("id", "user_id", "risk_level", "risk_score")
    d = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.length("text").alias("n"))
    child = lambda name, some: d.filter(some).select(F.concat(F.lit(name), "file_id").alias("id"), "file_id", "n")
    said = X.messages(spark, sf_dir).select("id", "file_id", F.length("content").alias("n"))
    s.upsert({"files": files, "findings": child("f", "file_id % 2 = 0"), "analyses": child("a", "true"), "messages": said})
    s.upsert({"files": files.filter(key % 3 == 0).withColumns({"risk_level": F.lit("SAFE"), "risk_score": F.lit(0)}), "analyses": child("a", "file_id % 4 = 0").withColumn("n", F.lit(-1))})
    s.delete(files.filter(key % 5 == 0))
    s.compact()
    s.upsert({"files": files.filter(key % 10 == 0).withColumn("risk_level", F.lit("LOW"))})
    s.delete(files.filter(key % 7 == 0))
    return s


_CHANGED = f"""with {X.CATALOGUE_SQL}, k as (select *, cast(id as bigint) as key from f), there as (select * from k where key % 7 <> 0 and (key % 5 <> 0 or key % 10 = 0)),
    gone as (select id from k where key % 5 = 0 or key % 7 = 0), changed as (
      select 'files' as t, id, case when key % 10 = 0 then 'LOW' when key % 3 = 0 then 'SAFE' else risk_level end as said, cast(case when key % 10 <> 0 and key % 3 = 0 then 0 else risk_score end as bigint) as n from there
      union all select 'findings', 'f' || doc_id, null, length(text) from documents where doc_id % 2 = 0 and cast(doc_id as varchar) not in (select id from gone)
      union all select 'analyses', 'a' || doc_id, null, case when doc_id % 4 = 0 then -1 else length(text) end from documents where cast(doc_id as varchar) not in (select id from gone)
      union all select 'messages', printf('%d-%05d', conv_id, turn), null, length(text) from conversations where cast(conv_id as varchar) not in (select id from gone))"""


@query(f"{_CHANGED} select * from changed")
def mutable_rows(spark, sf_dir):
    """All four tables after changes, deletions that cascade, compaction, and files that are uploaded again."""
    s = _filled(spark, sf_dir)
    out = s.read("files").select(F.lit("files").alias("t"), "id", F.col("risk_level").alias("said"), F.col("risk_score").cast("long").alias("n"))
    for t in ("findings", "analyses", "messages"):
        out = out.unionByName(s.read(t).select(F.lit(t).alias("t"), "id", F.lit(None).cast("string").alias("said"), F.col("n").cast("long").alias("n")))
    return out


@query(f"{_CHANGED} select t, count(*) as n_rows, sum(n) as n from changed group by 1")
def mutable_compacted(spark, sf_dir):
    """Counts and sums of the same tables once all changes are compacted."""
    s = _filled(spark, sf_dir)
    s.compact()
    s.vacuum()
    some = [s.read(t).select(F.lit(t).alias("t"), F.col("risk_score" if t == "files" else "n").cast("long").alias("n")) for t in store.TABLES]
    out = some[0]
    for x in some[1:]:
        out = out.unionByName(x)
    return out.groupBy("t").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").cast("decimal(38,0)").alias("n"))


# --- JSON columns ---------------------------------------------------

_PATHS = {"title": ("$.metadata.Title", "string"), "lines": ("$.stats.Lines", "string"), "evidence": ("$.evidence[0]", "string"), "header_hex": ("$.headerHex", "string"), "absent": ("$.stats.Pages", "int")}


@query("with a as (" + ORACLE["analyses_from_analysis"] + ") select file_id, title, lines, evidence, header_hex, cast(null as integer) as absent from a")
def analyses_by_path(spark, sf_dir):
    """Analyses of all pages, written with VARIANT columns, read again and queried by path."""
    reports = analyze.analyze(X.pages(spark, sf_dir))
    kept = shared.written(catalog.as_variants(catalog.analyses_table(reports, *engine._stored(reports))))
    return catalog.by_path(kept, "metadata", _PATHS, "file_id")


@query(
    """select event_id % 4 as part, count(*) as n, case event_id % 4 when 0 then 'OBJECT<k: BIGINT>' when 1 then 'OBJECT<k: BIGINT, s: ARRAY<STRING>>' when 2 then 'OBJECT<k: BIGINT, o: OBJECT<x: BOOLEAN>>' else 'OBJECT<k: BIGINT, s: STRING>' end as shape
      from events group by 1, 3"""
)
def json_shapes(spark, sf_dir):
    """The schema that the properties of events have in common, after fields were put into some of them."""
    e = X.table(spark, sf_dir, "events")
    more = F.when(F.col("event_id") % 4 == 1, ', "s": ["a", "b"]}').when(F.col("event_id") % 4 == 2, ', "o": {"x": true}}').when((F.col("event_id") % 4 == 3) & (F.col("event_id") % 8 == 3), ', "s": "t"}').otherwise("}")
    text = F.concat(F.regexp_replace("props", r"\}\s*$", ""), more)
    return catalog.shapes(e.select((F.col("event_id") % 4).alias("part"), F.parse_json(text).alias("v")), "v", "part")


# --- answers --------------------------------------------------------


def _every_third_fails(system: str, prompt: str) -> str:
    """A provider that fails on three kinds of prompts, by the number that they end in."""
    match int(prompt.rpartition(" ")[2]) % 9:
        case 2:
            raise asking.Busy
        case 5:
            raise asking.OutOfCredit
        case 8:
            raise ValueError("it broke")
    return prompt.upper()


@query(
    """select doc_id, case when k % 9 not in (2, 5, 8) then 'ABOUT ' || k end as first_answer, case k % 9 when 2 then 'busy' when 5 then 'no credit' when 8 then 'failed: it broke' end as error,
      case when k % 9 in (2, 5, 8) then 'about ' || k else 'ABOUT ' || k end as then_answer from (select doc_id, doc_id // 2 as k from documents)"""
)
def kept_answers(spark, sf_dir):
    """Two rows a prompt; a provider that fails every third, and another that is only asked what the first did not answer."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("about "), F.floor(F.col("doc_id") / 2).cast("string")).alias("prompt"))
    first, kept = asking.answered(d, "s", _every_third_fails)
    then, _ = asking.answered(d.withColumnRenamed("doc_id", "_doc"), "s", lambda system, prompt: prompt, kept)
    both = first.join(then.select("_doc", F.col("answer").alias("then_answer")), F.col("doc_id") == F.col("_doc"))
    return both.select("doc_id", F.col("answer").alias("first_answer"), "error", "then_answer")


# --- streams --------------------------------------------------------


def _arriving(spark, sf_dir):
    """The catalogue as a stream of three batches, in the order in which files were made."""
    path = shared.fresh(spark, "arriving")
    files = X.catalogue(spark, sf_dir).select("id", "user_id", "sha256", F.col("created_at").cast("timestamp").alias("created_at"))
    a, b = files.select(F.unix_micros("created_at").alias("t")).approxQuantile("t", [0.33, 0.66], 0.01) or (0, 0)
    at = F.unix_micros("created_at")
    for part in (at < a, (at >= a) & (at < b), at >= b):
        files.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(ORACLE["duplicates"])
def stream_duplicates(spark, sf_dir):
    """Duplicates among files that arrive in batches, by state per user and content."""
    return stream.bounded(stream.with_known(_arriving(spark, sf_dir)), each=stream.duplicates_of).select("id", "user_id", "duplicate_of")


@query("select distinct md5(html) as md5 from pages")
def stream_first_seen(spark, sf_dir):
    """Pages as files that arrive one a second, each thrice: of each content one is let through."""
    pages = spark.readStream.schema(X.table(spark, sf_dir, "pages").schema).parquet(f"{sf_dir}/page[s].parquet")
    blobs = X.source.from_table(pages.withColumn("again", F.explode(F.array(*map(F.lit, range(3))))), "page_id", F.lit("a.html"), F.col("html"))
    once = stream.bounded(stream.first_seen(blobs.withColumn("arrived", F.timestamp_seconds(F.lit(1_767_225_600) + F.col("blob_id")))))
    return once.select(F.md5("content").alias("md5"))
