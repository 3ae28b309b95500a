"""Files that arrive: large ones, copies in one batch and in later ones, and restarts."""

from datetime import datetime

from filescope.operators import analyze
from filescope.streaming import stream


def test_files_that_are_too_large_stay_rows(spark, tmp_path):
    (tmp_path / "small.txt").write_text("some plain text here")
    (tmp_path / "large.txt").write_text("x" * 500)
    found = stream.bounded(analyze.assess(stream.arriving(spark, str(tmp_path), limit=100)).select("file_name", "size", "content", "risk_level"))
    got = {r["file_name"]: r for r in found.collect()}
    assert set(got) == {"small.txt", "large.txt"}
    assert got["large.txt"]["content"] is None and got["large.txt"]["size"] == 500 and got["large.txt"]["risk_level"] == "UNKNOWN"
    assert got["small.txt"]["risk_level"] == "SAFE"


def test_duplicates_within_and_across_batches(spark, tmp_path):
    at = lambda n: datetime(2026, 1, 1, 0, 0, n)
    batches = [
        [("b", "u", "s", at(2)), ("a", "u", "s", at(1)), ("c", "u", "other", at(1)), ("d", "v", "s", at(5))],
        [("e", "u", "s", at(3)), ("f", "v", "s", at(4)), ("g", None, "s", at(1))],
        [("h", "v", "s", at(9)), ("i", None, "s", at(1)), ("j", "u", "new", at(0))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "id string, user_id string, sha256 string, created_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path))
    files = spark.readStream.schema("id string, user_id string, sha256 string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r["id"]: r["duplicate_of"] for r in stream.bounded(stream.with_known(files), each=stream.duplicates_of).collect()}
    # f was made before d, which came in an earlier batch: d stays, and what comes later is a copy of f.
    assert got == {"b": "a", "e": "a", "h": "f", "i": "g"}


def test_a_stream_without_input(spark, tmp_path):
    files = spark.readStream.schema("id string, user_id string, sha256 string, created_at timestamp").parquet(str(tmp_path))
    assert stream.bounded(stream.with_known(files), each=stream.duplicates_of).count() == 0
