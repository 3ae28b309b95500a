import random
import re

import numpy as np
import pyarrow as pa

from filescope.llm import jaccard

SCHEMA = "doc_id long, text string, node string"


def brute_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(data):
    sets = [brute_set(t) for _, t in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(data):
        groups.setdefault(root(i), []).append(doc)
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((doc, len(sets[i]), least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(data)), key=repr)


def corpus(seed=0):
    """Copies with edits at and around the threshold, a passage that many share, short and empty texts, clashing and null ids."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d e f", "x " * 50, "X " * 60, "é ü " * 9]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([9, 30, 120, 500]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            near = base.copy()
            for _ in range(rng.randrange(1 + len(near) // 25)):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near[: len(near) - rng.randrange(1 + len(near) // 8)]))
    for _ in range(25):
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(14))]))
    base = [word() for _ in range(150)]
    for _ in range(40):  # a large group of near copies, some beyond the threshold from each other
        near = base.copy()
        for _ in range(rng.randrange(5)):
            near[rng.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += texts[20:26]
    data = list(enumerate(texts))
    return [*data, (None, texts[30]), (None, "nobody says this but one without an id"), (7, texts[40]), (7, texts[60]), (7, texts[60])]


def run(spark, data, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in data], SCHEMA)
    return sorted((tuple(r) for r in jaccard.near_duplicates(df.repartition(5), **options).collect()), key=repr)


def test_join_against_brute_force(spark):
    data = corpus()
    want = brute(data)
    assert run(spark, data) == want
    linked = len({c for _, _, c in want})
    assert len(want) * 0.3 < linked < len(want) * 0.8


def test_split_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_LEAST", jaccard._LEAST[:1])  # the prefixes must find what one least hash does not
    data = corpus(1)
    assert run(spark, data, tile=3) == brute(data)


def test_prefixes_alone_find_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "around_leaders", lambda sets, tile: sets.select(jaccard.F.col("node").alias("a"), jaccard.F.col("node").alias("b")).limit(0))
    data = corpus(2)
    assert run(spark, data) == brute(data)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (1, None), (None, "")]) == [(1, 0, 1), (1, 0, 1), (None, 0, None)]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 10))).astype(np.uint64)]))
        if not len(y):
            continue
        t = jaccard.Tile(np.array([1, 2]), np.array([len(x), len(y)]), [jaccard.bitmap(x), jaccard.bitmap(y)])
        at, differ = t.near(0, np.ones(2, bool))
        both = len(np.intersect1d(x, y))
        assert (differ <= len(x) + len(y) - 2 * both).all()
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert len(at) == 1 and jaccard.fit(jaccard.bitmap(x), jaccard.bitmap(y), len(x) + len(y))
            assert len(t.near(1, np.array([True, False]), smaller=True)[0]) == 1


def test_sets_by_definition():
    texts = ["A b c d e f", "a B C d e F", "a b", "b a", "a a", "a a a", None, "", "x " * 30]
    sets = jaccard.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts] and (sets[0] == sets[1]).all()
    assert len({s.tobytes() for s in sets[2:6]}) == 4


def test_word_hashes(monkeypatch):
    rng = random.Random(1)
    texts = ["", None, "a", " a", "a b", "b a", "\x0b", "é", "ab", "ba", "", "A\tb\nC"] + ["".join(rng.choice("aAbB é\n\x1f") for _ in range(rng.randrange(40))) for _ in range(300)]
    for size in (1 << 17, 3):
        monkeypatch.setattr(jaccard, "WORDS_AT_ONCE", size)
        for cut in (0, 5):
            some = texts[cut:]
            w, at = jaccard.word_hashes(pa.array(texts).slice(cut))
            words = [re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())) for t in some]
            assert np.diff(at).tolist() == [len(x) for x in words]
            flat = [x for y in words for x in y]
            assert len(set(zip(flat, w.tolist(), strict=True))) == len(set(flat)) == len(set(w.tolist()))


def test_linked_sets_share_more_prefix_keys_than_are_spared():
    rng = np.random.default_rng(3)
    spare = lambda n: (4 * n + 4) // 5 // 10
    assert jaccard.SPARE == "(4 * n + 4) div 5 div 10"
    least = []
    for _ in range(2000):
        n = int(rng.integers(1, 300))
        both = rng.integers(0, 1 << 63, n)
        low = int(rng.integers(0, 2)) * (1 << 62)  # what only one set has may come first in the order
        extra = rng.integers(0, (1 << 63) - low, n * 100 // 80 - n)
        part = int(rng.integers(0, len(extra) + 1))
        x, y = (np.unique(np.concatenate([both, e]).astype(np.uint64)) for e in (extra[:part], extra[part:]))
        assert 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
        shared = len(np.intersect1d(jaccard.prefix(x), jaccard.prefix(y)))
        least.append(shared - max(spare(len(x)), spare(len(y))))
    assert min(least) >= 1
    for n in (10, 50, 99, 100, 101, 250):  # the worst case: all that only one set has comes first
        both = np.arange(1000, 1000 + n, dtype=np.uint64)
        x = np.concatenate([np.arange(n * 100 // 80 - n, dtype=np.uint64), both])
        shared = len(np.intersect1d(jaccard.prefix(x), jaccard.prefix(both)))
        assert shared > max(spare(len(x)), spare(n))
