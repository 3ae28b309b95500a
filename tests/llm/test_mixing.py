import numpy as np

from filescope.llm import mixing


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 50.0, "b": 100.0, "c": 150.0}
    got = mixing.targets([("a", 1000), ("b", 10), (None, 500)])
    assert got["b"] == 30.0
    assert abs(got["a"] - 1480 / 4) < 1e-9 and abs(got[None] - 1480 * 3 / 4) < 1e-9
    assert mixing.targets([]) == {}
    assert sum(mixing.targets([("\U00010000", 5), ("￿", 50), ("z", 5)]).values()) <= 60 + 1e-9


def test_fit_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(0, 30), 6, replace=False), rng.integers(1, 6, 6), strict=True)}
        total = sum(n * c for n, c in counts.items())
        budget = int(rng.integers(0, total + 10))
        took = mixing.fit(counts, budget)
        made = sum(n * c for n, c in took.items())
        assert all(0 <= took[n] <= counts[n] for n in counts) and made <= budget
        reach = {0}
        for n, c in counts.items():
            reach = {r + n * k for r in reach for k in range(c + 1)}
        assert max(r for r in reach if r <= budget) == made


def test_fit_of_large_budgets():
    counts = {n: 50 for n in range(1, 4000, 7)}
    budget = 41_234_567
    assert sum(n * c for n, c in mixing.fit(counts, budget).items()) == min(budget, sum(n * c for n, c in counts.items()))


def _mix(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    return mixing.mix(df).collect()


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 200)), ["a", "b", None][i % 3], "clash") for i in range(600)]
    rows += [(1000 + i, "same words here", "hot", "x") for i in range(9000)] + [(20_000, None, "hot", None), (None, "no id at all", "a", None), (7, "dup row", "a", None), (7, "dup row", "a", None)]
    rows += [(30_000, "", "empty", None)]
    out = _mix(spark, rows)
    assert len(out) == len(rows)
    by = {}
    for r in out:
        x = by.setdefault((r["target"], r["source_size"]), [0, 0, r["source_size"]])
        x[0] += r["taken"]
        x[1] += r["size"]
        assert r["taken"] == 0 or (r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"])
    assert len(by) == 5
    for (target, _), (taken, size, own) in by.items():
        assert size == own and abs(taken - target) <= 3
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, _mix(spark, rows[::-1])))


def test_empty(spark):
    assert _mix(spark, []) == []


def test_texts_without_ids_are_told_apart(spark):
    rows = [(None, f"text number {i}", "a", "x") for i in range(50)] + [(3, "one", "a", "x"), (3, "another", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tag string")
    taken = [r["text"] for r in mixing.apply(df, mixing.mix(df)).collect()]
    assert set(taken) == {t for _, t, _, _ in rows}
