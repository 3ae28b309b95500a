import hashlib
import random
from collections import Counter

import numpy as np

from filescope.llm import suffixes


def brute(texts, length):
    """For each text the maximal runs of bytes that strings of `length` starting at two places cover."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, np.int8)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        edges = np.flatnonzero(np.diff(gone))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), int(rng.integers(1, 8)))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    passages = [prose(int(rng.integers(30, 120))) for _ in range(12)]
    texts = [prose(int(rng.integers(0, 300))) for _ in range(60)]
    for i in range(40):
        p = passages[int(rng.integers(0, 12))]
        cut = int(rng.integers(0, len(p) // 2))
        texts.append(prose(int(rng.integers(0, 60))) + p[cut : cut + int(rng.integers(100, 500))] + prose(int(rng.integers(0, 60))))
    texts += [texts[3], texts[3], texts[5] + " tail", None, "", "ab" * 700, "x" * 300, "x" * 199, "x" * 200, texts[7][:-1] + "!", passages[0] + passages[0]]
    return texts


def run(spark, texts, length=200, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    out = suffixes.removed_spans(df.repartition(5), length=length, **options).collect()
    by = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in out}
    return [by[i] for i in range(len(texts))]


def test_against_brute_force(spark):
    texts = corpus()
    assert run(spark, texts) == brute(texts, 200)


def test_salted_grams_against_brute_force(spark):
    texts = corpus(1) + [f"{i} {i * i} lead " + corpus(1)[70] for i in range(30)]
    want = brute(texts, 60)
    assert run(spark, texts, 60, gram=16, per_group=3) == want
    assert run(spark, texts, 60, gram=16) == want


def test_parts_of_long_texts(spark, monkeypatch):
    texts = corpus(2)
    monkeypatch.setattr(suffixes, "PART", 97)
    for t in texts:
        data = (t or "").encode()
        found = suffixes.anchors(data)
        starts = [p for a, b in zip(found["first"], found["last"], strict=True) for p in range(a, b + 1)]
        assert starts == list(range(len(data) - 199))


def test_deep_shallow_orders_like_sorting():
    rng = np.random.default_rng(3)
    for length, alphabet in ((200, b"ab"), (37, b"ab"), (5, b"abc"), (64, b"a")):
        text = bytes(rng.choice(list(alphabet), 900)) + bytes(rng.choice(list(alphabet), 40)) * 9
        starts = rng.permutation(len(text) - length)[:500]
        order, group = suffixes.deep_shallow(text, starts, length)
        strings = [text[i : i + length] for i in order]
        assert strings == sorted(strings) and sorted(order) == sorted(starts)
        assert all((a == b) == (g == h) for a, b, g, h in zip(strings, strings[1:], group, group[1:], strict=False))


def test_digests_and_repeated_rows(spark):
    long = "".join(chr(97 + (i * i) % 26) for i in range(50)) * 20
    rows = [(1, long), (1, long), (None, "é" * 150), (2, None), (2, "short"), (3, "y" + "é" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffixes.digests(suffixes.removed_spans(df)).collect()
    assert len(out) == 6
    spans = brute([t for _, t in rows], 200)
    want = sorted((i or -1, len((t or "").encode()), sum(b - a for a, b in s), len(s), hashlib.sha256(suffixes.kept((t or "").encode(), [{"start": a, "end": b} for a, b in s])).hexdigest()) for (i, t), s in zip(rows, spans, strict=True))
    assert sorted((r[0] or -1, *tuple(r)[1:]) for r in out) == want
    assert suffixes.digests(suffixes.removed_spans(df.limit(0))).count() == 0


def test_order_and_groups_of_random_texts():
    rng = random.Random(2)
    for t in range(200):
        n, length = rng.randint(1, 300), rng.choice([5, 12, 30, 50])
        text = bytes(rng.choice(b"ab" if t % 2 else b"abcdefgh") for _ in range(n + length))
        starts = np.array(sorted(rng.sample(range(n), rng.randint(0, n))), np.int64)
        order, group = suffixes.deep_shallow(text, starts, length, rng.choice([8, 16, 24, 50]))
        own = [text[p : p + length] for p in order]
        assert own == sorted(own) and sorted(order.tolist()) == starts.tolist()
        assert all((a == b) == (g == h) for a, b, g, h in zip(own, own[1:], group, group[1:], strict=False))
