import os
import time

import pytest
from pyspark.sql import functions as F

from filescope.operators import catalog, prompts
from filescope.operators.analyze import analyze, assess
from filescope.sources import blobs
from filescope.streaming import stream
from tests import blobs as B


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in {"a.pdf": B.PDF, "b.txt": b"plain words", "copy.txt": b"plain words", "x.exe": B.pe()}.items():
        (path / name).write_bytes(data)
    return str(path)


def test_files_to_tables(spark, folder, tmp_path):
    reports = analyze(blobs.read_files(spark, folder))
    user, now = F.lit("u1"), F.timestamp_seconds(F.lit(1_700_000_000))
    files, found = catalog.files_table(reports, user, now), catalog.findings_table(reports, user, now)
    blobs.save({"files": files, "findings": found}, str(tmp_path / "cat"))
    files, found = (spark.read.parquet(str(tmp_path / "cat" / t)) for t in ("files", "findings"))
    by = {r["original_name"]: r for r in files.collect()}
    assert set(by) == {"a.pdf", "b.txt", "copy.txt", "x.exe"} and by["x.exe"]["risk_level"] == "HIGH" and by["a.pdf"]["status"] == "complete"
    assert [r["original_name"] for r in catalog.duplicates(files).collect()] in (["copy.txt"], ["b.txt"])
    assert catalog.of_files(found, files.filter("original_name = 'x.exe'")).count() == 2
    dead = files.filter("original_name = 'x.exe'").select("id")
    assert catalog.without(found, dead, "file_id").count() == found.count() - 2 and catalog.without(files, dead).count() == 3
    assert catalog.visible(files, "other").count() == 0
    assert catalog.one(files, F.col("original_name") == "a.pdf")["detected_type"] == "pdf"
    assert catalog.one(files, F.col("original_name") == "none", required=False) is None
    with pytest.raises(LookupError):
        catalog.one(files, F.col("size") >= 0)
    messages = spark.createDataFrame([(by["a.pdf"]["id"], "m1", "user", "why?", 2), (by["a.pdf"]["id"], "m0", "user", "hi", 1)], "file_id string, id string, role string, content string, created_at int")
    summaries = spark.createDataFrame([(by["a.pdf"]["id"], "old", 1), (by["a.pdf"]["id"], "new", 2)], "file_id string, summary string, created_at int")
    r = {x["original_name"]: x for x in catalog.report(files, found, messages, summaries).collect()}
    assert [m["content"] for m in r["a.pdf"]["messages"]] == ["hi", "why?"] and r["a.pdf"]["summary"] == "new" and r["b.txt"]["messages"] is None


def test_size_gate(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(b"x")
    os.truncate(tmp_path / "big.bin", 52_428_801)
    (tmp_path / "edge.bin").write_bytes(b"y")
    found = {r["file_name"]: r for r in assess(blobs.read_files(spark, str(tmp_path))).collect()}
    assert found["edge.bin"]["content"] == b"y" and found["big.bin"]["content"] is None and found["big.bin"]["size"] == 52_428_801
    assert found["big.bin"]["risk_level"] == "UNKNOWN" and not found["big.bin"]["scan_complete"]


def test_answers():
    full = prompts.read_answer('x ```json\n{"oneLiner": "a", "keyPoints": ["k", 3], "topics": "no"}\n``` y')
    assert full["oneLiner"] == "a" and full["keyPoints"] == ["k"] and full["topics"] == [] and full["detailed"] == ""
    plain = prompts.read_answer("first line\nrest")
    assert plain["oneLiner"] == "first line" and plain["detailed"] == "first line\nrest"
    assert prompts.read_answer(None)["keyPoints"] == []


def test_prompts(spark):
    history = [("user", str(i)) for i in range(25)]
    df = spark.createDataFrame([("a.txt", "txt", None, "SAFE", 0, [("low", "d")], [], "{}", "{}", "", history)], "n string, t string, m boolean, l string, s int, f array<struct<severity:string,description:string>>, notes array<string>, st string, me string, text string, h array<struct<role:string,content:string>>")
    p = prompts.summary_prompt(*map(F.col, ("n", "t", "m", "l", "s", "f", "notes", "st", "me", "text")))
    row = prompts.with_summary(df.select(p.alias("prompt"), prompts.conversation(F.lit("ctx"), F.col("h"), F.lit("q?")).alias("c"))).first()
    assert row["prompt"].split("\n")[2:6] == ["EXTENSION MATCHES CONTENT: no extension present", "SECURITY ENGINE VERDICT (authoritative): SAFE · score 0/100", "SECURITY FINDINGS: [low] d", "EXTRACTION NOTES: none"]
    assert prompts.NOTHING in row["prompt"] and row["summary"]["detailed"] == "Verdict SAFE · score 0/100."
    assert len(row["c"]) == 23 and row["c"][2]["content"] == "5" and row["c"][-1]["content"] == "q?"


def test_stream(spark, folder, tmp_path):
    batches = []
    query = stream.run(stream.first_seen(stream.arriving(spark, folder)), lambda df, i: batches.extend(r["file_name"] for r in df.select("file_name").collect()), str(tmp_path / "c"))
    try:
        for _ in range(60):
            query.processAllAvailable()
            if len(batches) >= 3:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert len(batches) == 3 and len({"b.txt", "copy.txt"} & set(batches)) == 1
    counted = stream.trend(assess(stream.arriving(spark, folder))).writeStream.format("memory").queryName("trend").outputMode("complete").start()
    counted.processAllAvailable()
    counted.stop()
    assert spark.sql("select sum(`count`) from trend").first()[0] == 4
