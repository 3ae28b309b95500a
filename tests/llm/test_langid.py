import zlib

import numpy as np
import pytest

from filescope.llm import langid


def test_segments_cover_the_text():
    for n in (0, 1, 127, 128, 129, 1000):
        data = bytes(range(1, 251)) * 4
        x, size = langid.segments(data[:n])
        assert b"".join(bytes(r[:k]) for r, k in zip(x, size, strict=True)) == data[:n]


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    net = langid.BiGRU(["a", "b", "c"], hidden=3)
    x, size, y = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.array([7, 3, 5, 7, 1]), np.array([0, 1, 2, 1, 0])
    _, g = net.gradient(x, size, y)
    for k, p in net.params.items():
        flat = p.reshape(-1)
        strongest = np.argsort(-np.abs(g[k]).reshape(-1))[:4]
        for i in strongest:
            old = flat[i]
            flat[i] = old + 1e-2
            up = net.gradient(x, size, y)[0]
            flat[i] = old - 1e-2
            down = net.gradient(x, size, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[k].reshape(-1)[i]) < 2e-3


def test_padding_does_not_matter():
    net = langid.BiGRU(["a", "b"])
    x, size = langid.segments(b"some bytes that are padded")
    noisy = x.copy()
    noisy[0, size[0] :] = 77
    assert np.allclose(net.pooled(x, size), net.pooled(noisy, size))
    assert np.allclose(net.pooled(x, size).sum(axis=1), size)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


def test_accuracy_on_held_out_documents(docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = langid.identify(docs).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    own = [r for r in out if r["held_out"] and truth[r["doc_id"]]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in own) / len(own) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_rows(spark):
    rows = [(i, w * 20, lang, 1.0) for i, (w, lang) in enumerate([("the cat sat ", "en"), ("der und die ", "de")] * 20)]
    rows += [(100, None, "en", 1.0), (101, "", None, 1.0), (102, "123 %%% _ ½ ② Ⅷ", "de", 1.0), (None, "the cat the ", None, 1.0), (103, "der die " * 20_000, None, 1.0), (104, "ß", "en", 1.0), (104, "ß", "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (100, 101, 102))
    assert by[None]["lang_pred"] == "en" and by[103]["lang_pred"] == "de"
    assert langid.identify(df.limit(0)).count() == 0


def test_prediction_runs_the_network_that_was_trained():
    rng = np.random.default_rng(5)
    net = langid.BiGRU(["a", "b", "c"])
    x, size = rng.integers(0, 256, (9, 20)).astype(np.uint8), rng.integers(1, 21, 9)
    score, _, live, _, _ = net.label(x, size)
    p = np.exp(score) / np.exp(score).sum(axis=2, keepdims=True) * live
    assert np.allclose(net.pooled(x, size), p.sum(axis=0)[:, :], atol=1e-4)
