import struct
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from filescope.functions import archive, pdf
from filescope.operators import extract as X
from filescope.operators.analyze import analyze
from tests import blobs as B


def read(kind, data, label="L", category="document", container=None):
    take = next((f for kinds, f in X.families.values() if kind in kinds or f"{category}:" in kinds), X.unknown)
    return X.read(take, data, X.Found(kind, label, category, container))


def test_pdf():
    r = read("pdf", B.PDF_FLATE)
    assert r.text == "Hello\nWorld\ninflated" and r.metadata["Title"] == "A (b)" and r.metadata["PDF version"] == "1.4"
    assert r.stats == {"Pages": 1, "Embedded images": 0, "Links": 1, "Encrypted": "no"} and r.tables[0]["rows"] == [["http://a.example/x"]]
    r = read("pdf", B.PDF + b"/Encrypt <<")
    assert r.unsupported and not r.text and r.notes


def test_office():
    r = read("docx", B.DOCX)
    assert "Title here" in r.text and "Body & more" in r.text and r.metadata["title"] == "My doc" and r.tables[0]["rows"] == [["Title here"]]
    r = read("xlsx", B.XLSX)
    assert r.text == "[One]\nName |  | 3\nAnn | 2" and r.stats["Formulas"] == 1 and r.tables[0]["columns"] == ["Name", "col_2", "3"]
    slides = B.zipped({"ppt/slides/slide1.xml": b"<a:t>One</a:t></a:p>", "ppt/notesSlides/notesSlide1.xml": b"<a:t>Say</a:t>", "ppt/media/i.png": b""})
    r = read("pptx", slides)
    assert r.text == "[Slide 1]\nOne\n\n[Speaker notes 1]\nSay" and r.stats["Embedded media"] == 1
    assert read("docx", b"PK\x03\x04").error == "ZIP end-of-central-directory record not found"
    assert [X.column_index(c) for c in ("A1", "Z9", "AA7", "BC12")] == [0, 25, 26, 54]


def test_delimited():
    r = read("csv", b'a,,d\n1,"x, ""y""",2024-01-02\n,z,2024-02-03\n-3,z,\n')
    assert r.tables[0]["rows"] == [["a", "integer", "1", "min -3 · max 1 · avg -0.67"], ["column_2", "text", "0", "2 distinct"], ["d", "date", "1", "3 distinct"]]
    assert r.tables[1]["rows"][0] == ["1", 'x, "y"', "2024-01-02"] and r.stats["Delimiter"] == ","
    assert read("csv", b"a;b\n1;2").stats == {"Rows": 1, "Columns": 2, "Delimiter": ";"}
    assert read("csv", b"h\n" + b"1\n" * 6000).stats["Rows"] == 4999


@given(st.lists(st.text(alphabet='ab",; ', max_size=6), min_size=1, max_size=5))
def test_quoted_cells_round_trip(cells):
    line = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    assert X.split_line(line, ",") == cells


def test_structured():
    r = read("json", b'{"a": [1, {"b": null}], "c": true}')
    assert r.metadata == {"Root type": "object", "Schema": "{ a: array[2] of number, c: boolean }"} and r.stats["Top-level keys"] == 2
    r = read("html", b"<title> T </title><script>x</script><p>Hi   <a href='u'>there</a></p>")
    assert r.metadata["Title"] == "T" and (r.stats["Elements"], r.stats["Links"]) == (4, 1) and r.text == "T Hi there"
    assert read("rtf", rb"{\rtf1\b Bold\'e9 text}").text == "Bold text"
    assert read("sql", b"create table a (x);; select 1;").metadata["Tables created"] == "create table a"
    assert read("txt", "é😀\n".encode()).stats == {"Characters": 4, "Lines": 2, "Words": 1}
    long = read("txt", b"x" * 70_000)
    assert long.truncated and len(long.text) == 60_000


def test_archives():
    r = read("zip", B.zipped({"a.exe": B.pe(), "b.txt": b"t", "big.bin": bytes(70_000), "d/": b""}))
    assert [(c["detected"], c["risk"], c["note"]) for c in r.children] == [("Windows Executable (PE)", "executable content", "high-risk extension"), ("text or unrecognised", "no signature-level threat", None), ("not inspected", "not scanned", None)]
    assert read("zip", B.locked(B.zipped({"a": b"x"}))).children[0]["detected"] == "encrypted"
    assert read("rar", b"Rar!", "RAR Archive").unsupported


def test_media_and_binaries():
    assert read("png", B.PNG, category="image").metadata["Width"] == 7
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 3) + bytes(9) + b"Make\0Canon X"
    assert {k: v for k, v in read("jpeg", jpeg, category="image").metadata.items() if k != "Format"} == {"Height": 30, "Width": 40, "Components": 3, "Embedded strings": "Make: Canon X"}
    assert read("gif", b"GIF89a" + struct.pack("<HH", 3, 4), category="image").metadata["Height"] == 4
    r = read("wav", B.wav(), category="audio")
    assert r.metadata["Sample rate"] == "44100 Hz" and r.metadata["Approx. duration"] == "2.0 s" and r.unsupported
    r = read("pe", B.pe(), category="binary")
    assert r.metadata["Architecture"] == "x86-64" and r.metadata["Subsystem type"] == "DLL (library)" and r.metadata["Compiled"] == "2001-09-09T01:46:40.000Z"
    assert r.tables[0]["rows"] == [[".text", "4096", "512", "execute/read"]] and r.tables[1]["rows"][0] == ["kernel32.dll"]
    elf = b"\x7fELF\2\1" + bytes(10) + struct.pack("<HH", 3, 0x3E)
    assert read("elf", elf, category="binary").metadata["Object type"] == "shared object"
    assert read("sqlite", b"SQLite format 3\0" + struct.pack(">H", 1) + b"\0CREATE TABLE t(x)\0").metadata["Page size"] == 1
    assert read("class", bytes.fromhex("CAFEBABE00000034")).metadata["Class file version"] == "52.0"
    assert read("wasm", b"\0asm\1\0\0\0").metadata["WASM version"] == 1
    assert read("unknown", b"\0longer than eight\0").text == "longer than eight"


def test_zip_limits():
    data = B.zipped({"a": bytes(5_000_000), "b": b"ok"})
    a, b = archive.directory(data)
    assert archive.read(data, a) is None and archive.read(data, b) == b"ok"
    with pytest.raises(archive.ZipError):
        archive.directory(b"no archive")


def test_all_kinds_of_damage(spark):
    rows, whole = [], [B.PDF_FLATE, B.DOCX, B.XLSX, B.pe(), B.PNG, B.wav()[:300], b"a,b\n1,2", b'{"a":1}']
    for data in whole:
        rows += [(len(rows) + i, f"f{n}", bytearray(data[:n])) for i, n in enumerate((0, 1, 5, 17, 40, len(data) // 2, len(data) - 1))]
    rows += [(9999, "null", None)]
    df = spark.createDataFrame(rows, "blob_id long, file_name string, content binary")
    out = analyze(df).collect()
    assert len(out) == len(rows) and all(r["extraction"] is not None and r["risk_level"] for r in out)


HOSTILE = [
    ("pdf", b"%PDF-1.4 [" + b"\\a" * 1_000_000), ("pdf", b"(" * 2_000_000), ("pdf", b"/Title(" * 280_000), ("pdf", b"/Filter/FlateDecode" * 100_000), ("pdf", b"/Filter/FlateDecode>>stream\n" * 70_000 + b"endstream"),
    ("html", b"<" * 2_000_000), ("html", b"<script" * 280_000), ("html", b"<title" * 280_000), ("txt", b" " * 2_000_000 + b"x"), ("rtf", b"\\a" * 1_000_000), ("json", b"[" * 2_000_000), ("csv", b'"' * 2_000_000),
]


@pytest.mark.parametrize("n", range(len(HOSTILE)))
def test_hostile_files_take_linear_time(n):
    kind, data = HOSTILE[n]
    began = time.perf_counter()
    assert read(kind, data).error is None
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("part", ["<si>", "<row>", "<c>", '<c r="A1"/>', 'w:val="Heading1"', "<", "<w:p>"])
def test_hostile_office_parts_take_linear_time(part):
    xml = part * (1_000_000 // len(part))
    began = time.perf_counter()
    X.Sheet(xml, []), X.shared_strings(xml), X.headings(xml), X.strip_xml(xml)
    assert time.perf_counter() - began < 10


def test_cells_that_are_closed_in_themselves_take_what_follows():
    sheet = X.Sheet('<row r="1"><c r="A1"/><c r="B1"><v>5</v></c><c r="D1"/></row><row/><row r="2"><c r="A2" t="s"><v>0</v></c></row>', ["s"])
    assert (sheet.rows, sheet.n_rows) == ([["5", "", "", ""], ["s"]], 2)
    assert X.strip_xml("<w:p><w:r><w:t>a</w:t></w:r></w:p><w:p x='1'><w:t>b  &amp;lt;</w:t></w:p>") == "\n a \n\n b &lt; \n"


def test_escapes_and_arrays_of_pdf_strings():
    assert pdf.shown(rb"(a\)b) Tj [(c) -3 (\(d)] TJ (e) ' [(x)] ( y )") == "a)b\nc(d\ne "
    assert pdf.shown(rb"[(a) [(b)] TJ (c)] TJ") == "b\n"
