import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from filescope.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_tokenizer_file(tokenizer, spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "a  b\n\n\n c \t", "<|endoftext|> don't 'LL we'll", "é\U0001f600� 12 345", " lead", "trail ", "word " * 40_000]
    for text in texts:
        assert packing.encode(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)]


def test_bound_and_packing_against_brute_force():
    rng = np.random.default_rng(0)

    def optimum(lengths, cap):
        best = len(lengths)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(lengths):
                best = len(rooms)
                return
            for room in set(rooms):
                if room >= lengths[i]:
                    rest = list(rooms)
                    rest[rest.index(room)] -= lengths[i]
                    go(i + 1, rest)
            go(i + 1, [*rooms, cap - lengths[i]])

        go(0, [])
        return best

    for _ in range(60):
        cap = int(rng.integers(5, 40))
        lengths = np.sort(rng.integers(1, cap + 1, 8))[::-1].copy()
        where, place, bins = packing.best_fit_decreasing(lengths, cap)
        best = optimum(lengths.tolist(), cap)
        assert packing.lower_bound(lengths, cap) <= best <= bins <= best * 1.5 + 1
        for b in range(bins):
            mine = sorted((int(p), int(n)) for p, n, w in zip(place, lengths, where, strict=True) if w == b)
            assert mine[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(mine, mine[1:], strict=False)) and sum(mine[-1]) <= cap


def _check(out, capacity):
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert v[0][0] == 0 and sum(v[-1]) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False))
    return len(by)


def test_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("source", "piece")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "same text"), (9003, "same text"), (None, "no id")], "doc_id long, text string")
    out = packing.pack_documents(docs.unionByName(extra, allowMissingColumns=True)).collect()
    n = _check(out, 1024)
    total = sum(r["length"] for r in out)
    assert n <= total / 1024 * 1.02 + 2
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((p for p in out if p["doc_id"] == r["doc_id"]), key=lambda p: p["piece"])
        assert [(p["start"], p["length"]) for p in mine] == packing.cut(len(ids), 1024)
        assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in mine)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_exchange_between_partitions(spark):
    found = spark.createDataFrame([(i, 0, 0, 1 + (i * 37) % 95, i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(found, 100, pieces_per_task=200).collect()
    assert len(out) == 3000
    total = sum(r["length"] for r in out)
    assert _check(out, 100) <= total / 100 * 1.03 + 2


def test_the_added_token_is_one_token(spark):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "x  <|endoftext|>\n\n y", "<|endoftext", "plain text", "word " * 20_000 + "<|endoftext|>" + " word" * 20_000]
    for text in texts:
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    (r,) = packing.pieces(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).collect()
    assert r["length"] == 5 and r["ids_crc32"] == zlib.crc32(np.array([64, 220, 50256, 275, 2], "<u4").tobytes())
