"""Import and export tables of forged PE files, sound and damaged."""

import random

import pytest

from filescope.functions import pe
from filescope.plans import fixtures as X

LIBRARIES = {"KERNEL32.dll": ["LoadLibraryA", 17, "GetProcAddress"], "ws2_32.dll": [115], "none.dll": []}
WANT = [("KERNEL32.dll", 0, "LoadLibraryA"), ("KERNEL32.dll", 1, "#17"), ("KERNEL32.dll", 2, "GetProcAddress"), ("ws2_32.dll", 0, "#115")]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("bound", [False, True])
def test_tables(wide, bound):
    image = pe.Image(X.pe_file(LIBRARIES, ["run", "stop"], b"body", wide, bound))
    assert list(image.imports()) == WANT and list(image.exports()) == [(0, "run"), (1, "stop")]
    assert [s.name for s in image.sections] == [".text", ".idata", ".edata"] and image.wide == wide
    none = pe.Image(X.pe_file({}, [], b"", wide))
    assert list(none.imports()) == [] == list(none.exports())


def test_an_address_lies_in_the_first_section_that_holds_it():
    image = pe.Image(X.pe_file(LIBRARIES, ["run"], b"text"))
    own = image.sections[1]
    assert image.place(own.address) == own.raw and image.place(own.address + own.extent - 1) == own.raw + own.extent - 1
    assert image.place(own.address + own.extent) is None and image.place(0) is None
    image.sections.insert(0, pe.Section("first", own.address, 1, 3))
    assert image.place(own.address) == 3 and image.place(own.address + 1) == own.raw + 1


def test_damage_never_raises_beyond_the_header():
    rng = random.Random(0)
    whole = X.pe_file(LIBRARIES, ["run"], b"text", True)
    for _ in range(400):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randrange(len(data) + 1)] if rng.random() < 0.3 else data)
        for f in (pe.Imports(), pe.Exports()):
            assert len(list(f.eval(data))) <= 8 * 4096
    assert list(pe.Imports().eval(None)) == list(pe.Imports().eval(b"MZ")) == list(pe.Exports().eval(b"text")) == []


def test_a_table_that_points_at_itself_ends():
    data = X.pe_file({"a.dll": ["f"] * 5000}, [], b"")
    assert len(list(pe.Imports().eval(data))) == pe.FUNCTIONS


def test_rows_of_a_table_of_files(spark):
    rows = [(1, X.pe_file(LIBRARIES, ["run"], b"x")), (2, b"no program"), (3, None), (1, X.pe_file({"b.dll": ["g"]}, []))]
    df = spark.createDataFrame(rows, "blob_id long, content binary")
    assert sorted(tuple(r) for r in pe.imports(df, "blob_id").collect()) == sorted([(1, *w) for w in WANT] + [(1, "b.dll", 0, "g")])
    assert [tuple(r) for r in pe.exports(df, "blob_id").collect()] == [(1, 0, "run")]
