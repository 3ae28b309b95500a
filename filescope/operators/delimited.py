"""Delimited files: lines as rows, quotes by parity, profiles by partial aggregation; all of it is Catalyst's.

The pieces of a line between its quotes are outside and inside of quotes in turn, so that marks in the first, third, ...
piece separate cells and those in the others don't; an empty piece between two quotes is a quote itself. Lines are dealt
over tasks one by one, whatever file they are of: a file of 5 MB keeps as many tasks busy as many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescope.functions import content, textual
from filescope.functions.names import trimmed
from filescope.functions.registry import EXTRACT_BYTES
from filescope.operators import profile
from filescope.operators.extract import DELIMITED_LINES, LINES_LEFT_OUT, PREVIEW_ROWS, STRUCT, TEXT_ROWS

#: Stands between cells in the meantime: no character. In a file it is shown as the replacement character.
_SEPARATOR = "﷐"


def mark_of(kind: Column, text: Column) -> Column:
    """The separator: a tab, or a semicolon if the first line has one, or a comma."""
    return F.when(kind == "tsv", "\t").when(F.contains(F.substring_index(text, "\n", 1), F.lit(";")), ";").otherwise(",")


def cells(line: Column, mark: Column) -> Column:
    """The cells of a line, without the quotes around them."""
    pieces = F.split(F.translate(line, _SEPARATOR, "�"), '"', -1)
    outside = lambda p: F.replace(p, mark, F.lit(_SEPARATOR))

    def piece(p: Column, i: Column) -> Column:
        quote = (p == "") & (i > 0) & (i < F.size(pieces) - 1)
        return F.when(i % 2 == 1, p).when(quote, '"').otherwise(outside(p))

    return F.split(F.when(F.contains(line, F.lit('"')), F.array_join(F.transform(pieces, piece), "")).otherwise(outside(F.translate(line, _SEPARATOR, "�"))), _SEPARATOR, -1)


def files(blobs: DataFrame) -> DataFrame:
    """Blobs (content, detection) of delimited types with `key`, `mark`, `lines` and `columns`: what their bytes alone say.

    Lines are those that are not empty, the first DELIMITED_LINES of the first EXTRACT_BYTES bytes. A file's key is a
    digest of its bytes and its type, so that copies are profiled once.
    """
    kind = F.col("detection.type")
    own = blobs.filter(kind.isin("csv", "tsv")).withColumn("_text", content.text(F.coalesce("content", F.lit(b"")), EXTRACT_BYTES))
    own = own.withColumns({"key": F.sha2(F.concat(F.encode(kind, "UTF-8"), F.coalesce("content", F.lit(b""))), 256), "mark": mark_of(kind, F.col("_text")), "lines": F.slice(F.filter(F.split("_text", r"\r?\n", -1), lambda x: x != ""), 1, DELIMITED_LINES)})
    header = F.coalesce(cells(F.get("lines", F.lit(0)), F.col("mark")), F.array().cast("array<string>"))
    named = F.transform(header, lambda h, i: F.coalesce(F.nullif(trimmed(h), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    return own.withColumn("columns", named).drop("_text")


def lines(found: DataFrame) -> DataFrame:
    """key, line (from 1), mark, n (columns), text: a row per line below the header of each distinct file."""
    body = F.slice("lines", 2, DELIMITED_LINES)
    flat = found.select("key", "mark", F.size("columns").alias("n"), F.posexplode(body).alias("line", "text"))
    return flat.dropDuplicates(["key", "line"]).withColumn("line", F.col("line") + 1)


def profiles(found: DataFrame) -> DataFrame:
    """key, place, and inferred type, missing values and statistics of each column, as text."""
    each = lines(found).filter("n > 0").select("key", cells(F.col("text"), F.col("mark")).alias("cells"), F.sequence(F.lit(0), F.col("n") - 1).alias("places"))
    flat = each.select("key", "cells", F.explode("places").alias("column")).select("key", "column", F.coalesce(F.get("cells", F.col("column")), F.lit("")).alias("value"))
    p = profile.profile(flat, "key")
    numeric = F.concat(F.lit("min "), textual.shortest(F.col("min")), F.lit(" · max "), textual.shortest(F.col("max")), F.lit(" · avg "), textual.fixed(F.col("avg"), 2))
    facts = F.when(F.col("avg").isNotNull(), numeric).otherwise(F.concat(F.col("distinct").cast("string"), F.lit(" distinct")))
    return p.select("key", F.col("column").alias("place"), "inferred_type", F.col("missing").cast("string").alias("missing"), facts.alias("facts"))


def extract(blobs: DataFrame) -> DataFrame:
    """Delimited blobs (content, detection) with `extraction`, as the other extractors give it; other types are left out.

    Averages are sums of partial sums, whose last bit may depend on the partitions. Null contents: no lines, no columns.
    """
    found = files(blobs)
    by_place = F.map_from_entries(F.collect_list(F.struct("place", F.struct("inferred_type", "missing", "facts"))))
    summed = profiles(found).groupBy("key").agg(by_place.alias("_profile"))
    both = found.join(summed.withColumnRenamed("key", "_of"), F.col("key") == F.col("_of"), "left")
    n = F.size("columns")
    table = lambda name, columns, rows, truncated: F.struct(F.lit(name).alias("name"), columns.alias("columns"), rows.alias("rows"), truncated.alias("truncated"))

    def profiled(name: Column, i: Column) -> Column:
        own = F.try_element_at("_profile", i)
        return F.array(name, F.coalesce(own["inferred_type"], F.lit("empty")), F.coalesce(own["missing"], F.lit("0")), F.coalesce(own["facts"], F.lit("0 distinct")))

    top = F.transform(F.slice("lines", 2, TEXT_ROWS), lambda x: cells(x, F.col("mark")))
    both = both.withColumn("_top", top)
    full = lambda row: F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(row, i - 1), F.lit("")))
    preview = F.when(n > 0, F.transform(F.slice("_top", 1, PREVIEW_ROWS), full)).otherwise(F.array().cast("array<array<string>>"))
    joined = F.array_join(F.concat(F.array(F.array_join("columns", " | ")), F.transform("_top", lambda r: F.array_join(r, " | "))), "\n")
    text, cut = textual.clamp(joined)
    rows = F.greatest(F.size("lines") - 1, F.lit(0))
    strings = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    result = F.struct(
        text, cut, strings(Rows=rows.cast("string"), Columns=n.cast("string"), Delimiter=F.when(F.col("mark") == "\t", "tab").otherwise(F.col("mark"))), strings(Encoding=F.lit("UTF-8 (assumed)")),
        F.array(table("Column profile", F.array(*map(F.lit, ("Column", "Inferred type", "Missing values", "Statistics"))), F.transform("columns", profiled), F.lit(False)), table("Data preview", F.col("columns"), preview, rows > PREVIEW_ROWS)),
        F.array(), F.when(F.size("lines") >= DELIMITED_LINES, F.array(F.lit(LINES_LEFT_OUT))).otherwise(F.array()), F.lit(False), F.lit(None),
    )
    return both.select(*blobs.columns, result.cast(STRUCT).alias("extraction"))

