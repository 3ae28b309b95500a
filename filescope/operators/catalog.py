"""The catalogue: files, findings, analyses and messages, and the queries over them.

Tables are append-only. A deletion is a tombstone that all reads leave out; a summary is a row of its own table, of
which the latest counts. Every query takes the tables of one user only: `visible` is the row-level policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filescope.functions.registry import ALERT_LEVELS, RISK_LABELS, RISK_ORDER
from filescope.sources import shared


def file_id(user: Column, sha256: Column, name: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", user, sha256, name), 256)


def files_table(reports: DataFrame, user: Column, created_at: Column) -> DataFrame:
    """A row per analysed file, with the table's defaults for what is missing."""
    d = lambda c: F.col(f"detection.{c}")
    return reports.select(
        file_id(user, F.col("sha256"), F.col("file_name")).alias("id"), user.alias("user_id"), F.col("file_name").alias("original_name"), "size", "sha256", "sha1", "md5", "declared_extension",
        F.coalesce(d("type"), F.lit("unknown")).alias("detected_type"), d("label").alias("detected_label"), d("mime").alias("mime_type"), d("category").alias("category"), F.coalesce(d("confidence"), F.lit(0.0)).alias("confidence"),
        "extension_match", "recommended_extension", "entropy", F.coalesce("risk_score", F.lit(0)).alias("risk_score"), F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level"),
        F.when(F.coalesce("scan_complete", F.lit(True)), "complete").otherwise("scan_incomplete").alias("status"), created_at.alias("created_at"),
    )


def findings_table(reports: DataFrame, user: Column, created_at: Column) -> DataFrame:
    """A row per finding, in the engine's order."""
    fid = file_id(user, F.col("sha256"), F.col("file_name"))
    rows = reports.select(fid.alias("file_id"), created_at.alias("created_at"), F.posexplode("findings").alias("position", "f"))
    return rows.select(F.sha2(F.concat_ws("\x1f", "file_id", F.col("position").cast("string")), 256).alias("id"), "file_id", "position", "f.category", "f.severity", "f.description", "f.evidence", "f.recommendation", "f.points", "created_at")


def analyses_table(reports: DataFrame, user: Column, created_at: Column) -> DataFrame:
    """A row per analysed file: what was extracted, and what is known of the file, as two structs."""
    fid = file_id(user, F.col("sha256"), F.col("file_name"))
    e = lambda c: F.col(f"extraction.{c}").alias(c)
    extracted = F.struct(*map(e, ("text", "truncated", "tables", "children", "notes")), F.coalesce("extraction.unsupported", F.lit(False)).alias("unsupported"), e("error"))
    known = F.struct(e("stats"), e("metadata"), F.col("detection.evidence").alias("evidence"), F.col("header_hex").alias("headerHex"), F.col("printable_ratio").alias("printableRatio"))
    return reports.select(F.sha2(F.concat_ws("\x1f", fid, F.lit("analysis")), 256).alias("id"), fid.alias("file_id"), extracted.alias("extracted_content"), known.alias("metadata"), created_at.alias("created_at"))


def as_variants(analyses: DataFrame) -> DataFrame:
    """Analyses whose two structs are VARIANT columns: JSON of any shape, stored in binary and read by path."""
    return analyses.withColumns({c: F.parse_json(F.to_json(c)) for c in ("extracted_content", "metadata")})


def by_path(df: DataFrame, column: str, paths: dict[str, tuple[str, str]], *keys: str) -> DataFrame:
    """keys, and a column for each path (name: path, type) of a VARIANT column; null where a row has no such path or type."""
    return df.select(*keys, *(F.try_variant_get(column, path, kind).alias(name) for name, (path, kind) in paths.items()))


def shapes(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, n, shape: the one schema that all values of a VARIANT column fit, by partial aggregation."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg(column).alias("shape"))


def messages_table(said: DataFrame, role: str, content: Column, created_at: Column) -> DataFrame:
    """Rows of messages about files (file_id): `user` for questions, `assistant` for answers."""
    stamp = F.concat_ws("\x1f", "file_id", F.lit(role), created_at.cast("string"), content)
    return said.select(F.sha2(stamp, 256).alias("id"), "file_id", F.lit(role).alias("role"), content.alias("content"), created_at.alias("created_at"))


def visible(files: DataFrame, user: str) -> DataFrame:
    """Rows of one user."""
    return files.filter(F.col("user_id") == user)


def of_files(children: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of a child table whose file is among `files`."""
    return children.join(files.select(F.col("id").alias("_id")), F.col(key) == F.col("_id"), "left_semi")


def without(df: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """`df` without rows of deleted files; give key="file_id" for the child tables."""
    return df.join(tombstones.select(F.col("id").alias("_id")), F.col(key) == F.col("_id"), "left_anti")


def latest(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("created_at"), "id").limit(n)


def history(files: DataFrame) -> DataFrame:
    return latest(files, 300)


def alerts(files: DataFrame, n: int = 200) -> DataFrame:
    return files.filter(F.col("risk_level").isin(ALERT_LEVELS)).orderBy(F.desc("risk_score"), "id").limit(n)


def dashboard_counts(files: DataFrame, window: int = 200) -> DataFrame:
    """Counts over the latest files: total, safe (SAFE and LOW), suspicious, high, critical."""
    one = lambda *levels: F.count_if(F.col("risk_level").isin(*levels))
    return latest(files, window).agg(F.count(F.lit(1)).alias("total"), one("SAFE", "LOW").alias("safe"), one("MEDIUM").alias("suspicious"), one("HIGH").alias("high"), one("CRITICAL").alias("critical"))


def type_distribution(files: DataFrame, window: int = 200, top: int = 8) -> DataFrame:
    """The most frequent types among the latest files, ties by first appearance, with the width of their bars."""
    recent = latest(files, window)
    rank = F.row_number().over(Window.orderBy(F.desc("created_at"), "id"))
    counted = recent.withColumn("rank", rank).groupBy("detected_type").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    total = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("width", F.greatest(F.lit(6.0), F.col("n") * 100.0 / total)).orderBy(F.desc("n"), "first").limit(top).select("detected_type", "n", "width")


def alert_preview(files: DataFrame, window: int = 200, n: int = 5) -> DataFrame:
    return latest(latest(files, window).filter(F.col("risk_level").isin(ALERT_LEVELS)), n)


def recent(files: DataFrame, n: int = 8) -> DataFrame:
    return latest(files, n)


def duplicates(files: DataFrame) -> DataFrame:
    """Files whose content their user has had before, with the earlier one's id."""
    seen = files.groupBy("user_id", "sha256").agg(F.min(F.struct("created_at", "id")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Written, so that the join's sides are two exchanges: Spark can then split the tasks of a content that a user has very often.
    both = files.join(shared.written(seen.select("user_id", "sha256", "_first")), ["user_id", "sha256"])
    return both.filter(F.struct("created_at", "id") != F.col("_first")).withColumn("duplicate_of", F.col("_first.id")).drop("_first").select(*files.columns, "duplicate_of")


def is_duplicate(new: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of `new` whose content the same user has in `files` already."""
    return new.join(files.select("user_id", "sha256"), ["user_id", "sha256"], "left_semi")


def report(files: DataFrame, findings: DataFrame, messages: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Each file with its findings by points and its messages by time; and its latest summary, if there are any."""
    f = findings.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("rank"), "position", "severity", "description", "points"))).alias("findings"))
    m = messages.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("messages"))
    out = files.join(f, files["id"] == f["file_id"], "left").drop("file_id").join(m, files["id"] == m["file_id"], "left").drop("file_id")
    if summaries is not None:
        last = summaries.groupBy("file_id").agg(F.max_by("summary", "created_at").alias("summary"))
        out = out.join(last, out["id"] == last["file_id"], "left").drop("file_id")
    return out


def one(df: DataFrame, condition: Column, required: bool = True):
    """The only row that meets a condition; None for none unless `required`. More than one: an error."""
    found = df.filter(condition).limit(2).collect()
    if len(found) > 1 or (required and not found):
        raise LookupError(f"{len(found)} rows where one is wanted")
    return found[0] if found else None


def only(df: DataFrame, condition: Column) -> DataFrame:
    """The only row that meets a condition, or none, as a table; more than one: the query fails when it runs."""
    found = df.filter(condition).limit(2).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return found.filter(F.when(F.col("_n") > 1, F.raise_error(F.lit("several rows where one is wanted"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def banner(files: DataFrame, findings: DataFrame, n: int = 5) -> DataFrame:
    """The first high or critical findings by points of each file at level HIGH or CRITICAL."""
    own = of_files(findings, files.filter(F.col("risk_level").isin("HIGH", "CRITICAL"))).filter(F.col("severity").isin("high", "critical"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("points"), "position"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= n)


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each file, with their place in time order."""
    w = Window.partitionBy("file_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("created_at", "id"))).drop("_n")


def risk_level(value: Column) -> Column:
    return F.when(value.isin(RISK_ORDER), value).otherwise("UNKNOWN")


def risk_label(value: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in RISK_LABELS.items() for x in kv)), risk_level(value))


def risk_trend(files: DataFrame) -> DataFrame:
    """Files by day and level."""
    return files.groupBy(F.to_date("created_at").alias("day"), "risk_level").agg(F.count(F.lit(1)).alias("n"))
