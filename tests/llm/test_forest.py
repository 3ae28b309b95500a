import numpy as np
import pytest

from filescope.llm import forest


def brute(rows, k, every=20):
    rows = sorted((r for r in rows if r[1] is not None and None not in list(r[1])), key=lambda r: list(r[1]), reverse=True)
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)}
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for i in ids:
        if i % every == 0:
            score = np.einsum("ij,j->i", x, ok[i])
            keep = ids != i
            order = np.lexsort((ids[keep], -score[keep]))[:k]
            out[int(i)] = list(zip(ids[keep][order].tolist(), score[keep][order].tolist(), strict=True))
    return out


def by_query(out):
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        mine = found.setdefault(r["query_id"], [])
        assert r["rank"] == len(mine) + 1 and r["vec_id"] != r["query_id"]
        mine.append((r["vec_id"], r["score"]))
    return found


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    rows += [(60, rows[40][1]), (500, None), (520, [0.0] * 8), (540, [float("nan")] * 8), (560, [None] + [1.0] * 7), (580, [float("inf")] * 8), (None, [1.0] * 8), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got, want = by_query(forest.search(df, "vec_id % 20 = 0", share=20).collect()), brute(rows, 20)
    assert got.keys() == want.keys()
    for i in want:
        assert [a for a, _ in got[i]] == [a for a, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=0, atol=1e-12)
    assert forest.search(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert len(forest.search(df.filter("vec_id in (20, 21, 22)"), "vec_id % 20 = 0").collect()) == 2


@pytest.mark.parametrize(("kind", "share"), [("sphere", forest.SHARE), ("clusters", forest.SHARE), ("clusters", 0.1), ("lengths", forest.SHARE)])
def test_recall(spark, kind, share):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32))
    if kind == "clusters":
        x = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] * 3 + 0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.uniform(0.3, 3, (6000, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = by_query(forest.search(df, "vec_id % 20 = 0", share=share).collect())
    want = brute([(i, v.astype(float)) for i, v in enumerate(x)], 20)
    recall = np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 20 for i in want])
    assert got.keys() == want.keys() and recall >= 0.9
