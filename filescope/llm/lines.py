"""Line deduplication: units by digest, the earliest kept, runs of repeated ones removed with their offsets.

A unit is a line or, in a line of several sentences, a sentence: it ends after a newline, or after a full stop, question
or exclamation mark and a space. Units are normalised and hashed by DataFrame functions where their text lies; only
digests and places are shuffled. The earliest occurrence of each digest is a minimum, which partial aggregation brings to
a row for each task; the join back is on digests that occur at least twice, and adaptive execution splits the tasks of
very common ones. Texts are shuffled once, to meet the places of their repeated units.

Short units coincide by chance, and so do longer ones in a large corpus: units of fewer than WORDS words are not compared,
and repeated ones are removed where a run of them, with short ones between, comes to RUN words.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, materialize, rows, text_tag, tune

#: Words of the shortest unit that is compared, and of the shortest run of repeated units that is removed.
WORDS, RUN = 4, 20
UNIT = r"[^\n]*?(?:[.!?] |\n)|[^\n]+"
BLANKS = r"[\t\n\r\x0B\x0C ]+"
_UNIT, _BLANKS = re.compile(UNIT), re.compile(BLANKS)


def normalised(unit):
    """In lower case, with blanks made one space. Most units have no two blanks together, nor any but spaces."""
    low = F.lower(unit)
    odd = low.contains("  ")
    for c in "\t\n\r\x0b\x0c":
        odd = odd | low.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(low, BLANKS, " ")).otherwise(low))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, tag, pos, digest: a row per unit of at least `words` words, by its place in the text; texts stay where they are."""

    def digest(unit):
        plain = normalised(unit)
        return F.when((plain != "") & (F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) >= words - 1), F.unhex(F.md5(plain)))

    found = F.transform(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(UNIT), F.lit(0)), digest)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_tag(F.col(text_col)).alias("tag"), F.posexplode(found).alias("pos", "digest")).filter("digest is not null")


def repeated(found: DataFrame) -> DataFrame:
    """doc_id, tag, pos of the units that an earlier one, by doc_id, tag and place, has said. `found` is read twice."""
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "tag", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    # Written, so that the join's sides are two exchanges: Spark can then split the tasks of a very common unit.
    first = materialize(first.filter("n > 1").select("digest", "first"))
    return found.join(first, "digest").filter(~F.struct("doc_id", "tag", "pos").eqNullSafe(F.col("first"))).select("doc_id", "tag", "pos")


def removed_runs(parts: list[str], again: set[int], words: int, run: int) -> list[tuple[int, int]]:
    """Runs (first unit, one after the last) of repeated units, `again`, that come to `run` words; short ones are passed over."""
    out: list[tuple[int, int]] = []
    first, after, total = 0, 0, 0
    for i, part in enumerate([*parts, None]):
        size = len(_BLANKS.sub(" ", part).strip(" ").split(" ")) if part is not None else 0
        if i in again:
            first, after, total = (i if not total else first), i + 1, total + size
        elif part is None or (size >= words and part.strip("\t\n\r\x0b\x0c ")):
            if total >= run:
                out.append((first, after))
            total = 0
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, run: int = RUN) -> DataFrame:
    """doc_id, n_units, n_removed, removed_chars, spans, kept_text of each row.

    spans has (start, length) of each run of removed units in code points of the original text, in order; kept_text is what
    is left. Units are compared in lower case with blanks made one; the earliest of equal ones stays, by doc_id (nulls
    first), then, of different texts with the same id or none, by the text's hash, then place in the text. A later one goes only in a run of such units of at least `run` words in all, where
    units of fewer than `words` words, which are not compared, may stand between. Null text: no units, null kept_text.
    Rows with the same id and text are one document: all of them keep or lose the same units. Extra columns are not read. An
    empty table: no rows.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    again = repeated(materialize(units(own, words=words)))
    again = again.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("pos")).alias("again")).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    both = own.join(again, own["doc_id"].eqNullSafe(again["_id"]) & (text_tag(F.col("text")) == again["_tag"]), "left").select("doc_id", "text", "again")
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("removed_chars", pa.int64()), ("spans", pa.list_(span)), ("kept_text", pa.string())])

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, text, seen in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "again")), strict=True):
            parts = _UNIT.findall(text or "")
            runs = removed_runs(parts, set(seen), words, run) if seen else []
            ends = [0, *accumulate(map(len, parts))] if runs else []
            spans = [{"start": ends[a], "length": ends[b] - ends[a]} for a, b in runs]
            kept, at = [], 0
            for s in spans:
                kept.append(text[at : s["start"]])
                at = s["start"] + s["length"]
            left = "".join([*kept, text[at:]]) if runs else text
            for name, value in zip(out, (doc, len(parts), sum(b - a for a, b in runs), sum(s["length"] for s in spans), spans, left), strict=True):
                out[name].append(value)
        return out

    return both.mapInArrow(lambda it: rows(it, schema, cut), "doc_id long, n_units long, n_removed long, removed_chars long, spans array<struct<start:long,length:long>>, kept_text string")


def digests(deduplicated: DataFrame) -> DataFrame:
    """The result of a query: counts, spans as start+length in a string, and the kept text's SHA-256 (null: empty)."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",")
    return deduplicated.select("doc_id", "n_units", "n_removed", "removed_chars", spans.alias("spans"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
with parts as (
  select doc_id, regexp_extract_all(text, '{UNIT}') as units from documents where text is not null
), flat as (
  select doc_id, unnest(units) as unit, unnest(range(len(units))) as pos from parts
), plain as (
  select *, trim(regexp_replace(lower(unit), '{BLANKS}', ' ', 'g'), ' ') as plain, length(unit) as len,
    sum(length(unit)) over (partition by doc_id order by pos rows between unbounded preceding and current row) - length(unit) as start
  from flat
), sized as (
  select *, case when plain = '' then 0 else length(plain) - length(replace(plain, ' ', '')) + 1 end as words from plain
), judged as (
  select *, words >= {WORDS} as compared, words >= {WORDS} and row_number() over (partition by plain order by doc_id, pos) > 1 as again from sized
), compared as (
  select *, sum(case when again then 0 else 1 end) over (partition by doc_id order by pos rows between unbounded preceding and current row) as stretch from judged where compared
), runs as (
  select doc_id, stretch, min(pos) as first, max(pos) as last from compared where again group by all having sum(words) >= {RUN}
), spans as (
  select r.doc_id, r.first, count(*) as n, cast(min(start) as bigint) as start, cast(sum(len) as bigint) as len
  from runs r join judged j on j.doc_id = r.doc_id and j.pos between r.first and r.last group by all
), removed as (
  select doc_id, sum(n) as n, sum(len) as len, string_agg(start || '+' || len, ',' order by start) as spans from spans group by 1
), kept as (
  select j.doc_id, count(*) as n, coalesce(string_agg(unit, '' order by pos) filter (s.doc_id is null), '') as text
  from judged j left join runs s on s.doc_id = j.doc_id and j.pos between s.first and s.last group by 1
)
select d.doc_id, cast(coalesce(k.n, 0) as bigint) as n_units, cast(coalesce(r.n, 0) as bigint) as n_removed,
  cast(coalesce(r.len, 0) as bigint) as removed_chars, coalesce(r.spans, '') as spans, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k using (doc_id) left join removed r using (doc_id)
"""
