import math
from collections import Counter

import pytest

import corpus_pipeline
from filescope.llm import packing
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_suffixes import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows, over a table with odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90_001, None, "en", "s", 0), (90_002, "", None, None, None), (90_003, "12 %%", "en", "s", 5), (None, "a text without an id here", None, None, 5), (90_004, "twice the same row there", "en", "s", 9), (90_004, "twice the same row there", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = []
    for name, f in corpus_pipeline.STAGES:
        before = docs
        docs = f(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append((name, before.collect(), rows, docs.columns == before.columns))
    return out


def test_language(stages):
    _, before, after, same = stages[0]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert same and gone == {90_001, 90_002, 90_003}
    assert Counter(after) - Counter(before) == Counter()


def test_near_duplicates(stages):
    _, before, after, same = stages[1]
    ids = [r["doc_id"] for r in before]
    comps = brute_components(ids, [brute_fingerprint(r["text"]) for r in before])
    want = {r for r, c in zip(before, comps, strict=True) if r["doc_id"] == c}
    assert same and len(after) == len(set(after)) and set(after) == want


def test_repeated_passages(stages):
    _, before, after, same = stages[2]
    spans = brute([r["text"] for r in before], 200)
    want = Counter()
    for r, s in zip(before, spans, strict=True):
        data, at, left = r["text"].encode(), 0, b""
        for a, b in s:
            left, at = left + data[at:a], b
        text = (left + data[at:]).decode("utf-8", "ignore")
        want[r["doc_id"], text, r["lang"], r["source"], len(text)] += 1
    assert same and Counter(tuple(r) for r in after) == want


def test_mixture(stages):
    _, before, after, same = stages[3]
    count, known = Counter(after), set(before)
    assert same and set(count) <= known and max(count.values()) <= 3
    size = Counter()
    for r in before:
        size[r["source"]] += len(r["text"].encode().split())
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    from filescope.llm.mixing import targets

    goal = targets([(s, size[s]) for s in names])
    took = Counter()
    for r in after:
        took[r["source"]] += len(r["text"].encode().split())
    for s in names:
        # Nothing that could be taken once more still fits.
        more = [n for r in known if r["source"] == s and count[r] < 3 and (n := len(r["text"].encode().split()))]
        assert 0 <= round(goal[s]) - took[s] < min(more, default=1)


def test_pack(stages):
    _, before, after, _ = stages[4]
    want = Counter()
    for r in before:
        for k, (start, length) in enumerate(packing.cut(len(packing.encode(r["text"])), 1024)):
            want[r["doc_id"], k, start, length] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in after) == want
    used: dict = {}
    for r in after:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in used.values():
        v.sort()
        assert v[0][0] == 0 and sum(v[-1]) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False))
    assert len(used) <= math.ceil(sum(r["length"] for r in after) / 1024) * 1.02 + 2


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), docs.schema) if f is not corpus_pipeline.pack else f(spark, docs, SF)
    assert docs.count() == 0


def test_texts_that_no_language_has_half_of_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    longest = {}
    for r in sorted(docs.filter("n_chars between 600 and 3000").collect(), key=lambda r: r["doc_id"]):
        longest.setdefault(r["lang"], []).append(r["text"][:600])
    mixed = [" ".join(texts) for texts in zip(*(v for k, v in sorted(longest.items()) if k), strict=False)][:5]
    odd = spark.createDataFrame([(90_100 + i, t, None, "s", len(t)) for i, t in enumerate(mixed)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(odd), SF).collect()}
    assert len(mixed) == 5 and kept == {r["doc_id"] for r in docs.collect()}
