import re

import numpy as np
import xxhash

from filescope.llm import simhash
from filescope.llm.components import components


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints, distance=4):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprint():
    texts = ["", None, "One two\x1fthree", "a b c d", "A b\tc\nd\x0be f  g", "é ü " * 30, "x " * 40_000]
    for t in texts:
        assert simhash.fingerprint(simhash.utf8(t)) == brute_fingerprint(t)


def test_masks_cover_all_close_pairs():
    rng = np.random.default_rng(0)
    for n in (10, 10**5, 10**7, 10**9, 10**12):
        m = simhash.masks(n)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flip & (x & 0xFFFFFFFFFFFFFFFF) == 0 for x in m)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = rng.choice(words, int(rng.integers(40, 400)))
        rows.append((len(rows), " ".join(base)))
        for _ in range(int(rng.integers(0, 6))):
            near = base.copy()
            for k in rng.integers(0, len(near), int(rng.integers(0, 4))):
                near[k] = "other"
            rows.append((len(rows), " ".join(near)))
    rows += [(900, None), (901, ""), (902, " \n"), (5, rows[5][1]), (None, rows[7][1]), (None, "alone here by itself now"), (904, "a"), (905, "b b")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints)
    assert len(set(want)) < len(rows) - 20
    order = lambda x: (-1 if x[0] is None else x[0], x[1], -1 if x[2] is None else x[2])
    expected = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want, strict=True)), key=order)
    for bucket in (4096, 3):
        assert sorted((tuple(r) for r in simhash.near_duplicates(df.repartition(3), bucket=bucket).collect()), key=order) == expected
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 5000) for i in range(200)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(1, 200)) and got[5000] == 1000
    assert 0 not in got and 3 in got


def test_representatives_without_ids_and_with_clashing_ones(spark):
    words = [f"w{i}" for i in range(400)]
    near = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    rows = [(5, near(), "x"), (None, near(200), "x"), (None, near(201), "x"), (None, near(202), "x"), (None, "stays as it is alone", "x"), (9, "one of two texts here", "x"), (9, "and quite another of the same", "x"), (9, "one of two texts here", "x"), (None, None, "x"), (None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    prints = {r["fp"] for r in simhash.fingerprints(df.limit(4)).collect()}
    assert len(prints) > 1 and all((a ^ b).bit_count() <= 4 for a in prints for b in prints)
    kept = [tuple(r) for r in simhash.representatives(df.repartition(3)).collect()]
    assert sorted(map(repr, kept[:])) == sorted(map(repr, [rows[0], rows[4], rows[5], rows[6], next(k for k in kept if not k[1])]))
    only = [(None, near(), "x"), (None, near(200), "x"), (7, near(201), "x"), (7, near(202), "x")]
    assert [r["doc_id"] for r in simhash.representatives(spark.createDataFrame(only, "doc_id long, text string, tag string")).collect()] == [7]
    assert simhash.representatives(df.limit(0)).count() == 0
