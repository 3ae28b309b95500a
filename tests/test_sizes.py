"""Rows that small tables lack, and what keeps queries within a task's memory on large ones."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filescope.plans import containers, engine  # noqa: F401 - each registers its queries
from filescope.sources import blobs

SMALL = "/root/testdata/sf0.001"


def against_sql(spark, folder, name, rows):
    """Rows of a query over documents, compared with its SQL."""
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    df = engine.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    found = con.sql(engine.ORACLE[name])
    assert ours == sorted((tuple(dict(zip(found.columns, r, strict=True))[c] for c in cols) for r in found.fetchall()), key=repr)
    return ours


def test_texts_that_complete_a_signature(spark, tmp_path):
    texts = ["asm and more of it", "abcftypisom and more", "x" * 256 + "ustar and more", "", None, "plain words here\x01and there"]
    assert len(against_sql(spark, tmp_path, "unknown_extract", list(enumerate(texts)))) == 6


@pytest.mark.parametrize("name", ["archive_stops", "archive_tree", "archive_summary"])
def test_large_documents_in_nested_archives(spark, tmp_path, name):
    text = " ".join(f"word{i * 7919 % 100_003}" for i in range(16_000))
    against_sql(spark, tmp_path, name, [(i, text[: 150_000 - i]) for i in range(6)])


def test_a_value_over_the_limit_is_not_part_of_the_plan(spark):
    assert len(engine.QUERIES["size_gate"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()) < 1_000_000


def test_arrow_batches_are_bounded(spark):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    count = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    few = blobs.from_table(spark.range(2000, numPartitions=1), "id", F.lit("a"), F.lit("x")).select(count("content").alias("n"))
    assert few.agg(F.max("n")).first()[0] <= 250
    large = blobs.from_table(spark.range(100, numPartitions=1), "id", F.lit("a"), F.repeat(F.lit("x"), (F.col("id") + 1_000_000).cast("int"))).select(count("content").alias("n"))
    assert large.agg(F.max("n")).first()[0] <= 2


@pytest.mark.parametrize(("name", "most"), [("probe_window", 2), ("office_docx", 4), ("office_xlsx", 4), ("archive_children", 4), ("archive_stats", 4), ("page_summaries", 4)])
def test_steps_of_python(spark, name, most):
    plan = engine.QUERIES[name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") <= most
