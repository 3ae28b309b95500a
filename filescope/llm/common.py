"""What the operators of this subpackage share: reading tables, tokens, and cutting lineage in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: ASCII white space, which is also what bytes.split() separates by.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` in the folder `sf_dir`, by Spark's reader, so that any store Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what an Arrow batch holds: texts may be very long, and a worker has little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's own where that is unset.

    Only a local master may fall back on a local folder; a cluster without the setting uses its warehouse.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints/filescope"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage is cut, and lost executors lose nothing of it.

    The files go when the driver's JVM ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/filescope-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._filescope_path = path
    # The finished plan's shuffle files go when the driver's garbage does; a small driver may not collect it for long.
    gc.collect()
    jvm.System.gc()
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._filescope_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def lower_words(data: bytes) -> list[bytes]:
    """The words of UTF-8 bytes, A-Z lower-cased and nothing else."""
    return data.translate(_LOWER).split()


def word_table(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column, lower-cased unless told otherwise, flat, and each text's offsets into them (nulls: no words)."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain) if lower else plain)
    words, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), kept[at]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_and_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that matter, under fixed names, whatever else the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_tag(text: Column) -> Column:
    """64 bits of a text: with its id, what tells a document from others, as ids may be null or repeat."""
    return F.xxhash64(text.cast("string"))


def rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, each) -> Iterator[pa.RecordBatch]:
    """Yield `each(batch)`, a dict of columns, as batches of `schema`."""
    for batch in batches:
        if batch.num_rows:
            out = each(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    give_back()


def give_back() -> None:
    """Return free memory to the system: a Python worker lives on, idle, beside the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """`run` as a function for mapInArrow that gives its memory back when a task is done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
