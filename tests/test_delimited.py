"""Delimited files by DataFrame functions against the same by plain Python, and how they spread over tasks."""

import random

import pytest

from filescope.functions import textual
from filescope.functions.content import fixed
from filescope.operators import delimited, extract

SCHEMA = "blob_id long, content binary, detection struct<type:string,label:string,category:string,container:string>"


def both(spark, contents):
    rows = [(i, c, (kind, "x", "data", None)) for i, (kind, c) in enumerate(contents)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ours = {r["blob_id"]: r["extraction"] for r in delimited.extract(df).collect()}
    plain = {i: extract.read(extract.delimited, c, extract.Found(kind, "x", "data")).row() for i, (kind, c) in enumerate(contents)}
    return ours, plain


def as_plain(e):
    return (e["text"], e["truncated"], e["stats"], e["metadata"], [t.asDict() for t in e["tables"]], e["children"], e["notes"], e["unsupported"], e["error"])


def hostile():
    rng = random.Random(5)
    pieces = ['"', '""', '"""', ",", ";", "\t", "a", " ", "1", "-2.5", "1e3", "\n", "\r\n", "é", "true", "2024-01-02", "0x1F", "yes", "1/2/2024", "\\", "0.1", "1234567.891"]
    out = [b"", b"\n\n", b"a,b\n", b"a;b\n1;2\n3;4", "﻿a,b\n1,2".encode(), b"a,,c\r\n1,2\r\n\r\n,,,\r\n", b"\xff,\xfe\n1,\xff", b'"a,b",c\n"x\ny",2']
    for _ in range(250):
        out.append("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))).encode())
    return [(rng.choice(["csv", "tsv"]), c) for c in out]


def test_the_same_as_plain_python(spark):
    contents = [*hostile(), ("csv", b"n,x\n" + b"".join(b"%d,%d.%d\n" % (i, i, i % 7) for i in range(6000))), ("csv", None), ("tsv", b"a\tb\n" + b"v\tw\n" * 300)]
    contents.append(contents[3])  # a copy
    ours, plain = both(spark, contents)
    assert len(ours) == len(contents)
    for i, want in plain.items():
        assert as_plain(ours[i]) == want, contents[i]


def test_one_file_is_spread_over_tasks(spark):
    row = b"some words here and there,12345,2024-01-02," + b"x" * 950 + b"\n"
    df = spark.createDataFrame([(1, b"a,b,c,d\n" + row * 4900, ("csv", "x", "data", None))], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = delimited.lines(delimited.files(df))
        sizes = [n for n in lines.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4900 and len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    assert "Python" not in delimited.extract(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_rounding_of_exact_values(spark, digits):
    rng = random.Random(digits)
    values = [1.005, 2.675, 0.125, 0.375, -0.125, -1.005, 0.0, 0.004, 0.5, 1.5, 2.5, 1e15, 123456789.125, 8.345, 1.45, 1e13 + 0.005, 33.333333]
    values += [round(rng.uniform(-1000, 1000), 3) for _ in range(500)] + [rng.randrange(10**6) / 8 for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", textual.fixed(textual.F.col("x"), digits).alias("s")).collect()
    assert [(r["x"], r["s"]) for r in got if r["s"] != fixed(r["x"], digits)] == []


def test_numbers_without_exponents(spark):
    values = [0.0, -1.0, 5e-4, 1e7, 12345678.25, 1e17, 0.001, 3.5, 1e10 + 0.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(textual.shortest(textual.F.col("x"))).collect()
    assert [r[0] for r in got] == ["0", "-1", "0.0005", "10000000", "12345678.25", "100000000000000000", "0.001", "3.5", "10000000000.5"]
