import re
import time

import pytest
from pyspark.sql import functions as F

from filescope.functions import registry
from filescope.functions.registry import SCRIPT_RULES
from filescope.operators.analyze import assess
from filescope.operators.rules import apply_rule
from tests import blobs as B

MZ = B.pe()
# name: (content, {category: points} beyond the baseline, score, level)
CASES = {
    "photo.jpg.exe": (MZ, {"Filename": 25, "Executable content": 40, "Static imports": 25}, 90, "CRITICAL"),
    "report.jpg": (B.PDF, {"Extension mismatch": 18, "PDF active content": 4}, 22, "LOW"),
    "report": (B.PDF, {"Extension": 5, "PDF active content": 4}, 9, "SAFE"),
    "invoice_12.js": (b"const a = 1;", {"Filename": 25, "Executable content": 20}, 45, "MEDIUM"),
    "a‮fdp.exe": (b"MZ", {"Filename": 25, "Executable content": 40}, 65, "HIGH"),
    "dispatch.csv": (b"a,b\n1,2", {"Filename": 25}, 25, "LOW"),
    "hidden.txt": (b"MZ stub", {"Extension mismatch": 45, "Executable content": 40}, 85, "CRITICAL"),
    "js.pdf": (b"%PDF-1.4 /JavaScript /OpenAction", {"PDF active content": 50}, 50, "MEDIUM"),
    "locked.pdf": (b"%PDF-1.4 /Encrypt <<", {"Encryption": 6}, 6, "SAFE"),
    "macro.docx": (B.zipped({"word/document.xml": b"", "word/vbaProject.bin": b""}), {"Office macros": 35}, 35, "MEDIUM"),
    "dropper.zip": (B.zipped({"x.exe": b"MZ"}), {"Embedded executable": 40}, 40, "MEDIUM"),
    "nested.zip": (B.zipped({"b.zip": b""}), {"Nested archive": 15}, 15, "LOW"),
    "slip.zip": (B.zipped({"../x.txt": b""}), {"Path traversal": 45}, 45, "MEDIUM"),
    "locked.zip": (B.locked(B.zipped({"a": b"x"})), {"Password protected": 20}, 20, "UNKNOWN"),
    "broken.zip": (b"PK\x03\x04junk", {"Scan error": 10}, 10, "UNKNOWN"),
    "many.zip": (B.zipped({f"f{i}": b"" for i in range(1001)}), {"Archive structure": 6}, 6, "SAFE"),
    "bomb.zip": (B.zipped({"z": bytes(60_000_000)}), {"Decompression bomb": 45}, 45, "MEDIUM"),
    "tmpl.docx": (B.zipped({"word/_rels/a.rels": b'attachedTemplate Target="http://x/y"', "word/document.xml": b""}), {"Remote content": 30}, 30, "LOW"),
    "evil.html": (b"<html><script >x</script><p onload=\"y\">http://1.2.3.4/</p>", {"Script analysis": 22, "Suspicious URL": 12}, 34, "LOW"),
    "formula.csv": (b"=1+1,2\n3,4", {"CSV injection": 14}, 14, "LOW"),
    "poly.png": (B.PNG + b"PK\x03\x04", {"Polyglot file": 30}, 30, "LOW"),
    "random.bin": (bytes(range(256)) * 40, {"Entropy": 14, "Unrecognised format": 15}, 29, "UNKNOWN"),
    "plain.txt": (b"nothing to see", {}, 0, "SAFE"),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, n, bytearray(c[0])) for i, (n, c) in enumerate(CASES.items())], "blob_id long, file_name string, content binary")
    return {r["file_name"]: r for r in assess(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_findings(found, name):
    _, want, score, level = CASES[name]
    r, sums = found[name], {}
    for f in r["findings"]:
        sums[f["category"]] = sums.get(f["category"], 0) + f["points"]
    assert sums == (want or {"Baseline": 0})
    assert (r["risk_score"], r["risk_level"]) == (score, level)
    assert r["risk_score"] == min(100, sum(f["points"] for f in r["findings"]))


def test_texts(found):
    assert found["report.jpg"]["findings"][0]["evidence"] == "Declared .jpg · Detected pdf (95% confidence)"
    assert found["bomb.zip"]["findings"][0]["evidence"].endswith(":1 (60 MB expanded)")
    assert found["photo.jpg.exe"]["findings"][-1]["evidence"] == "VirtualAlloc, WinExec"
    assert found["broken.zip"]["findings"][0]["evidence"] == "ZIP end-of-central-directory record not found"
    assert found["js.pdf"]["findings"][0]["evidence"] == r"\/JavaScript|\/JS[\s/<]"
    assert found["tmpl.docx"]["findings"][0]["evidence"] == 'Target="http://x/y"'


def test_filters_on_results_stay_cheap_to_plan(spark):
    df = spark.createDataFrame([(1, "a.txt", bytearray(b"x"))], "blob_id long, file_name string, content binary")
    assert assess(df).filter("risk_level = 'SAFE' and size(findings) > 0").count() == 1


def test_hostile_texts_take_linear_time(spark):
    texts = ["curl " * 380_000, "curl x|" * 280_000, "\n" * 260_000, "[" * 260_000, "](a" * 80_000, "[a](b" * 50_000, "#" * 260_000]
    df = spark.createDataFrame([(i, "a.txt", bytearray(t.encode())) for i, t in enumerate(texts)], "blob_id long, file_name string, content binary")
    assess(df.limit(1)).collect()
    began = time.perf_counter()
    assert len(assess(df).collect()) == len(texts)
    assert time.perf_counter() - began < 60


def test_pipelines_are_found_as_by_the_pattern(spark):
    rule = next(r for r in SCRIPT_RULES if r.id == "C5")
    texts = ["curl x | sh", "curl|sh", "wget a\n|bash x", "curl a | cat | sh", "x | curl b |  bash", "curl a | b; wget c |SH", "", "curl ", "Curl é | bash|sh", "| sh", "curl a || sh"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", apply_rule(rule, F.col("t"), 120)["evidence"].alias("e"))
    want = [(m := re.search(rule.pattern, t)) and m[0][:120] for t in texts]
    assert [r["e"] for r in df.orderBy("i").collect()] == want


def test_points_and_severities_as_they_are_specified():
    """Written out, so that a number that is wrong in the registry is not right in a query's SQL as well."""
    patterns = {
        "R1": ("high", 25), "R2": ("high", 25), "R3": ("high", 25), "R4": ("high", 25),
        "P1": ("high", 28), "P2": ("high", 22), "P3": ("medium", 14), "P4": ("critical", 34), "P5": ("medium", 16), "P6": ("medium", 12), "P7": ("low", 4), "P8": ("info", 0), "P9": ("low", 6),
        "C1": ("high", 20), "C2": ("medium", 12), "C3": ("critical", 30), "C4": ("high", 22), "C5": ("critical", 30), "C6": ("low", 6), "C7": ("low", 5), "C8": ("medium", 12), "C9": ("medium", 10),
    }
    noted = {
        "R5a": ("critical", 45), "R5b": ("medium", 18), "R6": ("low", 5), "R7a": ("high", 40), "R7b": ("medium", 20), "R8": ("medium", 14), "R9": ("medium", 15),
        "Z1": ("high", 35), "Z2": ("critical", 40), "Z3": ("medium", 15), "Z4": ("medium", 20), "Z5": ("critical", 45), "Z6": ("critical", 45), "Z7": ("low", 6), "Z8": ("high", 30), "Z9": ("medium", 20),
        "C10": ("medium", 14), "C11": ("medium", 12), "X1": ("high", 25), "Y1": ("high", 30), "E1": ("medium", 10), "none": ("info", 0),
    }
    assert {r.id: (r.severity, r.points) for r in (*registry.NAME_RULES, *registry.PDF_RULES, *registry.SCRIPT_RULES)} == patterns
    assert {k: (f.severity, f.points) for k, f in registry.FINDINGS.items()} == noted
    assert registry.RISK_LEVELS == [(80, "CRITICAL"), (60, "HIGH"), (35, "MEDIUM"), (12, "LOW"), (0, "SAFE")]
