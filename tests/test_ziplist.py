"""The data source of ZIP entries: what it reads of files, and what it gives for broken ones."""

import struct
import zlib

import pytest

from filescope.functions import archive
from filescope.plans import fixtures as X
from filescope.sources import ziplist


def load(spark, path, **options):
    spark.dataSource.register(ziplist.ZipDirectories)
    return spark.read.format("zip_directory").options(**options).load(str(path)).collect()


def sparse(path, size):
    """A ZIP file of one stored entry of `size` zeros, which takes no room on disk."""
    fields = struct.pack("<HHHHIIIHH", 0, 0, 0, 0, 0, size, size, 3, 0)
    with open(path, "wb") as f:
        f.write(b"PK\x03\x04" + struct.pack("<H", 20) + fields + b"big")
        f.seek(33 + size)
        central = b"PK\x01\x02" + struct.pack("<HH", 20, 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, 0) + b"big"
        f.write(central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), 33 + size, 0))


def test_large_files_are_listed_without_their_bodies(spark, tmp_path):
    for i in range(5):
        sparse(tmp_path / f"{i}.zip", 900_000_000 + i)
    got = load(spark, tmp_path, filesPerPartition=2, dataStart=True)
    assert sorted((r["name"], r["uncompressed_size"], r["data_start"]) for r in got) == [("big", 900_000_000 + i, 33) for i in range(5)]
    assert all(r["bytes_read"] < 100_000 < r["file_size"] for r in got)


def test_entries_equal_those_of_the_whole_bytes(spark, tmp_path):
    files = {
        "a.zip": X.container({f"d/{i}.txt": b"x" * i for i in range(300)}, deflated=True),
        "long.zip": X.container({"n" * 5000 + str(i): b"" for i in range(40)}),  # a directory larger than what is read ahead
        "locked.zip": X.stored_zip("é.txt", "text", "b", True),
        "empty.zip": b"PK\x05\x06" + bytes(18),
        "no.zip": b"plain text",
        "none.zip": b"",
        "cut.zip": X.container({"a": b"1", "b": b"2"})[:-30],
        "odd.zip": X.container({"a": b"1"}).replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 9, 9)),
        "other.txt": X.container({"a": b"1"}),
    }
    (tmp_path / "sub").mkdir()
    for i, (name, data) in enumerate(files.items()):
        (tmp_path / ("sub" if i % 2 else ".") / name).write_bytes(data)
    found = {}
    for r in load(spark, tmp_path, pathGlobFilter="*.zip", dataStart=True):
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append((*[r[f] for f in archive.Entry._fields], r["error"]))
    want = {}
    for name, data in files.items():
        try:
            rows = [(*e, None) for e in archive.directory(data)]
        except archive.ZipError as e:
            rows = [(*[None] * len(archive.Entry._fields), str(e))]
        if rows and name.endswith(".zip"):
            want[name] = rows
    assert {k: sorted(v, key=repr) for k, v in found.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert len(want["a.zip"]) == 300 and "empty.zip" not in want and want["no.zip"][0][-1]


def test_one_file_a_missing_folder_and_wrong_options(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(X.container({"a": b"1"}))
    assert [r["name"] for r in load(spark, tmp_path / "a.zip")] == ["a"] and load(spark, tmp_path, pathGlobFilter="*.jar") == []
    for options in ({"filesPerPartition": 0}, {}):
        with pytest.raises(Exception, match="filesPerPartition|No such|Cannot|not exist|not found|FileNotFound"):
            load(spark, tmp_path if options else tmp_path / "nowhere", **options)


def test_crc_of_listed_entries():
    data = X.container({"a": b"abc"})
    assert archive.directory(data)[0].crc32 == zlib.crc32(b"abc")
    assert archive.directory_of(lambda a, n: data[a : a + n], len(data), starts=False)[0].data_start == 0
