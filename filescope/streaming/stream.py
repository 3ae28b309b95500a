"""Analysis of files as they arrive, duplicates among them, and trends. All transforms of files are row-local, so they run on streams too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from filescope.functions.registry import MAX_FILE
from filescope.operators.analyze import assess
from filescope.sources import shared
from filescope.sources.blobs import from_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, limit: int = MAX_FILE) -> DataFrame:
    """Blobs of files that appear in a folder, with their `arrived` time; larger ones are rows without content.

    These are not read: they come from a listing of their own. Their level is UNKNOWN, as for tables of files.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    large = files.filter(F.col("length") > limit).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return from_files(files.filter(F.col("length") <= limit).unionByName(large), F.col("modificationTime").alias("arrived"))


def first_seen(blobs: DataFrame, within: str = "1 hour") -> DataFrame:
    """Blobs whose content has not arrived in the time before; state is dropped once the watermark passes."""
    return blobs.withColumn("sha256", F.sha2("content", 256)).withWatermark("arrived", within).dropDuplicatesWithinWatermark(["sha256"])


def trend(assessed: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Files by window of arrival and risk level."""
    return assessed.withWatermark("arrived", late).groupBy(F.window("arrived", window), "risk_level").count()


# --- duplicates -----------------------------------------------------

KNOWN = "user_id string, sha256 string, id string, at long, known_at long, known_id string"


class Earliest(StatefulProcessor):
    """State of a user's content: when its earliest file was made, and which one it is; dropped after `ttl` milliseconds.

    Each row goes on with what was known before its batch. Rows are not gathered, however many a batch has of a content.
    """

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at long, id string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802,N803 - Spark's names
        before = tuple(self.first.get()) if self.first.exists() else None
        least = before
        for r in rows:
            own = (r["at"], r["id"])
            least = own if least is None or own < least else least
            yield Row(user_id=key[0], sha256=key[1], id=r["id"], at=r["at"], known_at=before[0] if before else None, known_id=before[1] if before else None)
        self.first.update(least)

    def close(self) -> None:
        pass


def with_known(files: DataFrame, ttl: int | None = None) -> DataFrame:
    """Arriving rows of files (id, user_id, sha256, created_at) with the earliest file of that content before their batch.

    Times are in microseconds, as `at` and `known_at`.
    Needs the state store that keeps state on disk; ttl is in milliseconds of processing time, None for ever.
    """
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = files.select("user_id", "sha256", "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")).groupBy("user_id", "sha256")
    return keyed.transformWithState(Earliest(ttl), KNOWN, "append", "processingTime" if ttl else "none")


def duplicates_of(batch: DataFrame) -> DataFrame:
    """id, user_id, sha256, created_at, duplicate_of of a batch of with_known(): its files but for the earliest of each content.

    A file that arrives in a later batch than one that was made after it is no duplicate, and the one before stays one.
    """
    own, known = F.struct("at", "id"), F.struct(F.col("known_at").alias("at"), F.col("known_id").alias("id"))
    # Written, so that the join's sides are two exchanges: Spark can then split the tasks of a very common content.
    first = shared.written(batch.groupBy("user_id", "sha256").agg(F.least(F.min(own), F.min(F.when(F.col("known_id").isNotNull(), known))).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 or _first.id is not null"))
    both = batch.join(first, (batch["user_id"].eqNullSafe(first["user_id"])) & (batch["sha256"].eqNullSafe(first["sha256"]))).filter(own != F.col("_first"))
    return both.select("id", batch["user_id"], batch["sha256"], F.timestamp_micros("at").alias("created_at"), F.col("_first.id").alias("duplicate_of"))


# --- running --------------------------------------------------------


def run(blobs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Assess arriving blobs and hand each batch to `sink`; restarts go on from the checkpoint."""
    return assess(blobs).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def bounded(found: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that a stream gives of the input that is there now, as a table in the shared folder, where its state is, too.

    Each batch is a folder of its own, which a batch that is run again writes again. In mode "complete" the last one counts.
    `each` is applied to batches. Without input: no rows, in the columns that `each` makes of an empty batch.
    """
    spark = found.sparkSession
    path, checkpoint = shared.fresh(spark, "stream"), shared.fresh(spark, "state")
    empty = spark.createDataFrame([], found.schema)
    schema = (each(empty) if each else empty).schema

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else f'batch={number}'}")

    found.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
