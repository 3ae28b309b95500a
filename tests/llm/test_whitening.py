import math

import numpy as np
import pytest

from filescope.llm import whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(rows):
    """Plain two-pass covariance in exact integers; components by the singular vectors of the centred matrix."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    away = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for _, x in kept])
    _, s, vt = np.linalg.svd(away, full_matrices=True)
    value = np.zeros(d)
    value[: len(s)] = s**2 / n
    deviation = [sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for _, x in kept]
    return [i for i, _ in kept], away, value, vt, deviation


def by_vector(found):
    out = {}
    for r in found:
        out.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    return out


def test_whitening_against_svd(spark):
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(40, 40)) * np.linspace(3, 0.2, 40)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 40)) @ mix)]
    data += [(900, None), (901, [0.5] * 39 + [None]), (902, [0.5] * 39 + [NAN]), (903, [INF] + [0.5] * 39), (904, []), (905, [1.0, 2.0]), (None, data[4][1]), (7, data[9][1]), (7, data[7][1])]
    full = [(i, v) for i, v in data if v is None or len(v) == 40]
    ids, away, value, vt, deviation = brute(full)
    df = spark.createDataFrame([(i, v, "x") for i, v in data], SCHEMA)
    found = whitening.whiten(df.repartition(7)).collect()
    assert len(found) == 32 * len(ids) == 32 * 303
    assert {r["n"] for r in found} == {303} and {r["component"] for r in found} == set(range(1, 33))
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    got = by_vector(found)
    assert {(i, s) for i, s in zip(ids, deviation, strict=True)} == set(got)
    for c in range(32):
        want = away @ vt[c] / math.sqrt(value[c])
        have = np.array([got[(i, s)][c + 1]["whitened"] for i, s in zip(ids, deviation, strict=True)])
        assert np.allclose(have, want * np.sign(want @ have), atol=1e-7)
        assert abs(got[(0, deviation[0])][c + 1]["explained"] / (value[c] / value.sum()) - 1) < 1e-9


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "")], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.25, -3.0], "")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(1, 1, 1, 0, 0.0, 0.0, 0.0), (1, 2, 1, 0, 0.0, 0.0, 0.0)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i), 5.0], "") for i in range(4)], SCHEMA)).collect()
    first = sorted((r["vec_id"], r["whitened"]) for r in line if r["component"] == 1)
    assert np.allclose([abs(w) for _, w in first], [1.5 / math.sqrt(1.25), 0.5 / math.sqrt(1.25)] * 1 + [0.5 / math.sqrt(1.25), 1.5 / math.sqrt(1.25)])
    assert all(r["whitened"] == 0 for r in line if r["component"] > 1) and line[0]["identity_error"] < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0], ""), (2, [1.0, 1.0], "")], SCHEMA)).collect()
    assert {r["vec_id"] for r in huge} == {2}


def test_merging_holds_far_from_the_origin():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, (500, 6)) + 10**9
    parts = [whitening.moments(p) for p in np.split(x, [3, 200, 201])]
    total = None
    for p in parts:
        total = whitening.merged(total, p)
    exact = np.cov((x - 10**9).T, bias=True)
    assert np.allclose(total.scatter / total.n, exact, rtol=0, atol=1e-6) and (total.sums == x.sum(0)).all() and total.n == 500


def test_deviation_beyond_a_long_is_an_error():
    w = whitening.Whitening(10**6, np.array([0]), np.zeros((1, 1)), np.zeros(1), 0)
    assert whitening.exact_deviation(np.array([[2000]]), w) == [4 * 10**18]
    with pytest.raises(ArithmeticError):
        whitening.exact_deviation(np.array([[4000]]), w)
