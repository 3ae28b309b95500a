
import pytest
from pyspark.sql import functions as F

from filescope.functions import names
from filescope.operators.analyze import assess
from tests import blobs as B

# name: (content, type, confidence, extension match, recommended)
CASES = {
    "report.pdf": (B.PDF, "pdf", 95, True, None),
    "report.jpg": (B.PDF, "pdf", 95, False, "pdf"),
    "report": (B.PDF, "pdf", 95, None, "pdf"),
    "data.txt": (B.XLSX, "xlsx", 99, False, "xlsx"),
    "image.pdf": (B.PNG, "png", 98, False, "png"),
    "photo.jpg.exe": (B.pe(), "pe", 99, True, None),
    "hidden.txt": (b"MZ stub", "pe", 75, False, "exe"),
    "invoice_12.js": (b"const a = 1;", "script", 70, True, None),
    "script.txt": (b"import os\n", "script", 70, False, "txt"),
    "a.odt": (B.zipped({"mimetype": b"application/vnd.oasis.opendocument.text"}, 0), "odt", 99, True, None),
    "b.epub": (B.zipped({"mimetype": b"application/epub+zip"}, 0), "epub", 99, True, None),
    "c.apk": (B.zipped({"AndroidManifest.xml": b"", "classes.dex": b""}), "apk", 98, True, None),
    "d.jar": (B.zipped({"META-INF/MANIFEST.MF": b"", "A.class": b""}), "jar", 96, True, None),
    "e.doc": (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "WordDocument".encode("utf-16-le"), "doc", 92, True, None),
    "f.doc": (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 Microsoft Excel", "xls", 92, False, "xls"),
    "g.ppt": (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole", 80, True, None),
    "h.json": (b' {"a": [1, 2]} ', "json", 98, True, None),
    "i.json": (b'{"a": NaN}', "txt", 70, False, "txt"),
    "events.jsonl": (b'{"a": 1}\n{"a": 2}\n', "jsonl", 90, True, None),
    "numbers.txt": (b"1\n2", "jsonl", 90, False, "jsonl"),
    "j.csv": (b"a,b\n1,2\n\n3,4\n", "csv", 88, True, None),
    "k.tsv": (b"a\tb\r\n1\t2", "tsv", 88, True, None),
    "l.csv": (b"a;b\n1;2", "csv", 88, True, None),
    "m.sql": (b"-- x\nselect 1", "txt", 70, False, "txt"),
    "n.sql": (b"/* create table t (x int)", "sql", 80, True, None),
    "o.yml": (b"# c\nkey: value\n", "yaml", 72, True, None),
    "p.md": (b"# Head\ntext", "markdown", 70, True, None),
    "q.svg": (b"<?xml version='1.0'?><svg >", "svg", 96, True, None),
    "r.html": (b"  <!DOCTYPE HTML><p>", "html", 94, True, None),
    "s.go": (b"package main\n", "script", 70, True, None),
    "t.heic": (b"\0\0\0\x18ftypmif1", "heic", 96, True, None),
    "random.bin": (bytes(range(128, 256)) * 20 + b"\0", "unknown", 5, True, None),
    "lie.mp3": (b"\0\1\2", "unknown", 15, True, None),
    "empty.": (b"", "unknown", 5, None, None),
    "BM.txt": (b"BM is how it starts", "bmp", 82, False, "bmp"),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, n, bytearray(c[0])) for i, (n, c) in enumerate(CASES.items())], "blob_id long, file_name string, content binary")
    return {r["file_name"]: r for r in assess(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_types_and_extensions(found, name):
    _, kind, confidence, match, recommended = CASES[name]
    r = found[name]
    assert (r["detection"]["type"], r["detection"]["confidence"], r["extension_match"], r["recommended_extension"]) == (kind, confidence, match, recommended)


def test_evidence(found):
    assert found["report.pdf"]["detection"]["evidence"] == ["Magic bytes matched at offset 0: 25 50 44 46 2D"]
    assert found["data.txt"]["detection"]["evidence"][1:] == ["ZIP container with 3 entries", r"OOXML part matching ^xl\/"]
    assert found["photo.jpg.exe"]["detection"]["evidence"][1] == "PE signature located at 0x40"
    assert found["j.csv"]["detection"]["evidence"] == ["Consistent 2-column delimited structure across 3 sampled lines"]
    assert found["lie.mp3"]["detection"]["evidence"][2] == 'Filename extension suggests "mp3" but content does not confirm it'
    assert found["report.pdf"]["header_hex"].startswith("25 50 44 46 2D 31 2E 34")
    assert found["empty."]["entropy"] == 0 and found["empty."]["header_hex"] == ""


NAMES = {
    "a.TXT": "txt", ".bashrc": None, "a.": None, "x/y\\b.tar.gz": "gz", " c.pdf ": "pdf", "noext": None, "a.b\n": "b", "": None,
}


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r["n"]: r for r in df.select("n", names.extension(F.col("n")).alias("e"), names.sanitize(F.col("n")).alias("s")).collect()}
    assert {n: r["e"] for n, r in got.items()} == NAMES
    assert got["x/y\\b.tar.gz"]["s"] == "b.tar.gz" and got[""]["s"] == "file" and got["a.b\n"]["s"] == "a.b"
    again = df.select(names.sanitize(names.sanitize(F.col("n"))).alias("b"), names.sanitize(F.col("n")).alias("a")).collect()
    assert all(r["a"] == r["b"] for r in again)


def test_registry():
    from filescope.functions.registry import EXTENSION_MAP, SIGNATURES, ranked_signatures

    assert len(SIGNATURES) == 47 and len({s.type for s in SIGNATURES}) == 43 and len(EXTENSION_MAP) == 84
    assert [s.type for s in ranked_signatures()[:2]] == ["m4a", "mov"]
