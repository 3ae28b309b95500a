"""Where blobs come from, and where analyses go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.functions import names
from filescope.functions.registry import MAX_FILE

BLOB = "blob_id long, file_name string, content binary, size long"
#: Rows and bytes of an Arrow batch, the first that is reached: contents may be large, and rows wait for their batch in a task.
BATCH_ROWS, BATCH_BYTES = 250, 1 << 20


def bounded(df: DataFrame) -> DataFrame:
    """`df`, with what an Arrow batch holds bounded for its session, from which plans take it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Blobs of a folder's files, subfolders included. Files over 50 MiB are rows without content: they are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    large = files.filter(F.col("length") > MAX_FILE).select("path", F.lit(None).cast("binary").alias("content"), "length")
    return from_files(files.filter(F.col("length") <= MAX_FILE).select(large.columns).unionByName(large))


def from_files(files: DataFrame, *others) -> DataFrame:
    return bounded(files).select(F.xxhash64("path").alias("blob_id"), names.sanitize(F.col("path")).alias("file_name"), "content", F.col("length").alias("size"), *others)


def from_table(df: DataFrame, id_col: str, file_name, content) -> DataFrame:
    """Blobs from a table: a name and bytes (or text, in UTF-8) for each row; too large ones are rows without content."""
    data = content if dict(df.select(content.alias("c")).dtypes)["c"] == "binary" else F.encode(content, "UTF-8")
    out = bounded(df).select(F.col(id_col).cast("long").alias("blob_id"), names.sanitize(file_name).alias("file_name"), data.alias("content"))
    out = out.withColumn("size", F.length("content").cast("long"))
    return out.withColumn("content", F.when(F.col("size") <= MAX_FILE, F.col("content")))


def save(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Append each table under its name; a table's files appear together or not at all."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
