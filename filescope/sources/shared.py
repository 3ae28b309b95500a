"""The folder that driver and executors share, and tables that are written there to cut a plan's lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the warehouse where that is unset; only a local master falls back on a local folder."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints/filescope"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def fresh(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has yet; it goes when the driver's JVM ends."""
    path = f"{folder(spark)}/filescope-{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)  # what does not exist yet would not be deleted
    system.deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared folder, read again: what lost executors held is not computed anew."""
    path = fresh(df.sparkSession, "table")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
