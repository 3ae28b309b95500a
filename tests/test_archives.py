"""Archives in archives: limits, broken members, and trees of hostile files."""

import struct
import zlib

from filescope.operators import archives
from filescope.plans import fixtures as X

SCHEMA = "blob_id long, file_name string, content binary, size long"


def tree(spark, contents, **limits):
    rows = [(i, f"{i}.zip", c, len(c) if c is not None else 60_000_000) for i, c in enumerate(contents)]
    found = archives.tree(spark.createDataFrame(rows, SCHEMA), archives.Limits(**limits))
    return {(r["root_id"], r["path"].partition("!/")[2]): r for r in found.collect()}


def test_the_budget_is_shared_and_never_passed(spark):
    inner = X.container({"x.txt": b"x" * 3000, "y.txt": b"y" * 3000})
    root = X.container({"a.txt": b"a" * 1000, "one.zip": inner, "two.zip": inner, "z.txt": b"z" * 500}, deflated=True)
    total = 1000 + 2 * len(inner) + 500
    for extra, read in ((2 * 3000, 1), (2 * 3000 - 1, 0), (2 * 6000, 2), (10**6, 2)):
        got = tree(spark, [root], total=total + extra)
        for name in ("one.zip", "two.zip"):
            assert [got[0, f"{name}!/{k}"]["state"] for k in ("x.txt", "y.txt")] == ["read"] * read + ["over budget"] * (2 - read)
        assert sum(r["size"] for r in got.values() if r["depth"] and r["state"] == "read") <= total + extra
        assert got[0, "one.zip"]["stopped"] == (read < 2) and not got[0, ""]["stopped"]


def test_members_that_lie_or_are_broken(spark):
    swollen = bytearray(X.container({"a": b"\0" * 100_000}, deflated=True, declared=10))
    wrong = bytearray(X.container({"a": b"some text", "b": b"fine"}))
    wrong[wrong.index(b"some text")] ^= 1
    got = tree(spark, [bytes(swollen), bytes(wrong), b"PK\x03\x04 no directory", b"plain text", None, b""])
    assert got[0, "a"]["state"] == got[1, "a"]["state"] == "broken" and got[1, "b"]["state"] == "read"
    assert got[2, ""]["risk_level"] == "UNKNOWN" and got[4, ""]["state"] == "too large"
    assert len(got) == 9 and not any(r["stopped"] for r in got.values())


def test_large_members_and_depth(spark):
    deep = b"end of it"
    for i in range(7):
        deep = X.container({f"{i}.zip" if i else "end.txt": deep})
    got = tree(spark, [deep, X.container({"big": b"\0" * 5000, "d/": b"", "d/s.txt": b"s"}, deflated=True)], depth=3, entry=4000)
    assert max(r["depth"] for r in got.values()) == 3
    last = next(r for r in got.values() if r["root_id"] == 0 and r["depth"] == 3)
    assert last["stopped"] and last["risk_level"] == "UNKNOWN" and last["findings"][-1]["evidence"] == "not opened"
    assert got[1, "big"]["state"] == "too large" and got[1, ""]["stopped"] and (1, "d/") not in got and got[1, "d/s.txt"]["state"] == "read"


def test_an_archive_that_holds_itself_many_times_ends(spark):
    wide = b"PK\x05\x06" + bytes(18)
    for _ in range(4):
        wide = X.container({f"{i}.zip": wide for i in range(6)}, deflated=True)
    got = tree(spark, [wide], depth=9, total=20_000)
    read = sum(r["size"] for r in got.values() if r["depth"] and r["state"] == "read")
    assert read <= 20_000 and any(r["stopped"] for r in got.values())


def test_members_stream_in_batches(spark, monkeypatch):
    monkeypatch.setattr(archives, "BATCH", 1000)
    entries = {f"{i}.txt": bytes([65 + i % 26]) * 400 for i in range(50)}
    assert [own for _, _, own, _ in archives.members(X.container(entries), 10**6, archives.Limits())] == list(entries.values())
    assert len(tree(spark, [X.container(entries)])) == 51


def test_summary_of_several_roots(spark):
    exe = X.container({"in.zip": X.container({"run.exe": b"MZ" + bytes(70)})})
    rows = [(7, "a.zip", exe, len(exe)), (8, "b.txt", b"just text", 9)]
    out = {r["root_id"]: r for r in archives.summary(archives.tree(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (out[7]["members"], out[7]["deepest"], out[7]["worst_level"]) == (2, 2, "MEDIUM") and out[7]["complete"]
    assert (out[8]["members"], out[8]["expanded"], out[8]["worst_path"]) == (0, 0, "b.txt")


def test_checks_of_a_member_use_its_crc():
    data = X.container({"a": b"abc"})
    at = data.index(b"PK\x01\x02") + 16
    other = data[:at] + struct.pack("<I", zlib.crc32(b"abd")) + data[at + 4 :]
    assert [s for _, s, _, _ in archives.members(other, 100, archives.Limits())] == ["broken"]
