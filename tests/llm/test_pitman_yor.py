import re
import time
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filescope.llm import pitman_yor as py
from filescope.llm.common import lower_words, utf8


def words_of(text):
    return [w.decode() for w in lower_words(utf8(text))]


def test_tokens():
    texts = ["A b\tB  é\x0bÉ ", None, "", " \n", "one", "x\x1fy z\x0c"]
    own = ["b", "one"]
    distinct, word, ctx, at = py.tokens(pa.array(texts), pa.array(own, pa.large_string()))
    names = distinct.to_pylist()
    for i, t in enumerate(texts):
        want = [*(w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in utf8(t)))), ""]
        assert [names[w] for w in word[at[i] : at[i + 1]]] == want
        cls = [0, *(py.CLASSES + own.index(w) if w in own else 1 + zlib.crc32(w.encode()[-2:]) % (py.CLASSES - 1) for w in want[:-1])]
        assert ctx[at[i] : at[i + 1]].tolist() == cls


def test_seat_has_the_expected_number_of_tables():
    keys = py.mixed(np.arange(4000, dtype=np.uint64))
    for d, a in ((0.5, 1.0), (0.8, 0.3), (0.3, 400.0)):
        for n in (1, 2, 5, 40, 500, 3000):
            got = py.seat(np.full(4000, n), np.full(4000, a), d, keys)
            t = np.array([1.0])  # distribution of tables by dynamic programming
            for i in range(1, n):
                p = a / (i - d * np.arange(1, len(t) + 1) + a)
                t = np.append(t * (1 - p), 0) + np.append(0, t * p)
            mean = float(t @ np.arange(1, len(t) + 1))
            assert abs(got.mean() - mean) < 0.05 + 0.05 * mean
    # Each cell's tables are its own, whatever is seated beside it.
    n, a = np.arange(1, 4001) % 700, np.linspace(0.1, 50, 4000)
    whole, part = py.seat(n, a, 0.5, keys), py.seat(n[1000:1200], a[1000:1200], 0.5, keys[1000:1200])
    assert (whole[1000:1200] == part).all()


def test_binomial():
    u, v = (py.uniform(py.mixed(np.arange(20_000, dtype=np.uint64)), k) for k in (1, 2))
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    for n, p in ((1, 0.5), (3, 0.999999), (40, 0.1), (40, 0.97), (5000, 0.3), (5000, 0.999), (100_000, 1e-4)):
        x = py.binomial(n, np.full(len(u), p), u, v)
        assert x.min() >= 0 and x.max() <= n and abs(x.mean() - n * p) < 4 * (n * p * (1 - p) / len(u)) ** 0.5 + 1e-9 and abs(x.var() - n * p * (1 - p)) < 0.05 * n * p * (1 - p) + 1e-3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"], "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "same twice", "x"), (5002, "same twice", "x"), (None, "no id here", "x"), (5003, "unseenword " * 3, "x")]
    return rows


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


@pytest.mark.parametrize("head", [py.HEAD, 500, 0])
def test_scores(spark, docs, head):
    df = spark.createDataFrame(docs, "doc_id long, text string, word string")
    out = py.score_documents(df.repartition(3), head=head).collect()
    assert len(out) == len(docs)
    train = Counter(w for i, t, _ in docs if not held(i) for w in [*words_of(t), ""])
    n, v = sum(train.values()), len(train)
    by = {(r["doc_id"], r["n_tokens"]): r for r in out}
    for i, t, _ in docs:
        ws = [*words_of(t), ""]
        r = by[i, len(ws)]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held(i), sum(w in train for w in ws), n)
        assert abs(r["base_score"] - sum(log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6
        assert r["score"] < 0
    if head == 0:
        return
    ours, base = (sum(r[c] for r in out if r["held_out"]) for c in ("score", "base_score"))
    assert ours > base


def test_the_same_by_broadcast_and_join(spark, docs, monkeypatch):
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    own = py.common_words(df, 50)
    count = Counter(w for _, t, _ in docs for w in words_of(t))
    want = sorted(count, key=lambda w: (-count[w], w))
    assert own[:20] == want[:20] and set(own[:40]) <= set(want[:50])
    words, totals, discounts = py.train(df, own)
    scores = lambda n, dense: {(r["doc_id"], r["n_tokens"]): r["score"] for r in (monkeypatch.setattr(py, "DENSE", dense), py.score(df, own, words, totals, discounts, head=n).collect())[1]}
    a, b, c = scores(py.HEAD, py.DENSE), scores(100, py.DENSE), scores(5000, 20)
    assert a.keys() == b.keys() == c.keys() and all(abs(a[k] - b[k]) < 1e-3 and abs(a[k] - c[k]) < 1e-3 for k in a)
    # The predictive probabilities after any context sum to one, and a text's score is the sum of their logarithms.
    scale, rest, root, base = py._weights(totals, discounts)
    rows = words.collect()
    p1 = {r["word"]: (np.array(r["root"]) - discounts[1] * np.array(r["root_tables"])) * root + base for r in rows}
    assert np.abs(sum(p1.values()) + base - 1).max() < 1e-4
    cell = {(r["word"], c["ctx"]): c["n"] - discounts[0] * c["t"] for r in rows for c in r["cells"]}
    for u in range(py.CLASSES + len(own)):
        seen = sum(x * scale[u] for (_, ctx), x in cell.items() if ctx == u)
        assert abs(seen + rest[:, u].mean() - 1) < 1e-4
    for doc, text, _ in docs[:40]:
        _, word, ctx, _ = py.tokens(pa.array([text]), pa.array(own, pa.large_string()))
        total = sum(log10(cell.get((w, u), 0) * scale[u] + float(np.mean(rest[:, u] * p1.get(w, base)))) for w, u in zip([*words_of(text), ""], ctx.tolist(), strict=True))
        assert abs(total - a[doc, len(word)]) < 1e-3


def test_reruns_agree_whatever_the_partitions(spark, docs):
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    a, b = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in py.score_documents(df.repartition(n)).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_no_training_texts(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    (r,) = py.score_documents(df).collect()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["score"]) < 1e-9 and abs(r["base_score"]) < 1e-9
    assert py.score_documents(df.limit(0)).count() == 0


def test_the_context_is_the_whole_word_before(spark):
    # "xaa" and "yaa" end alike, so that classes of endings cannot tell what follows them.
    rows = [(i, "xaa left" if i % 2 else "yaa right") for i in range(400)]
    rows = [r for r in rows if not held(r[0])]
    test = [i for i in range(1000, 2000) if held(i)][:4]
    rows += [(test[0], "xaa left"), (test[1], "xaa right"), (test[2], "yaa right"), (test[3], "yaa left")]
    out = {r["doc_id"]: r["score"] for r in py.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[test[0]] > out[test[1]] + 1 and out[test[2]] > out[test[3]] + 1


def test_more_contexts_than_numbers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for n in (-1, py.MOST_OWN + 1):
        with pytest.raises(ValueError, match="own_contexts"):
            py.score_documents(docs, own_contexts=n)


def pairs_of(texts):
    return Counter(p for t in texts for ws in [[*words_of(t), ""]] for p in zip([py.START, *ws], ws))


def cell_of(*pairs):
    u, w = (py.word_ids(pa.array(list(x), pa.large_string())) for x in zip(*pairs, strict=True))
    return py.cell_keys(u, w).tolist()


def test_every_word_before_is_a_context(spark):
    # A thousand words before, more than the smaller model has contexts of their own, all end alike, and each has one word after it.
    rows = [(i, " ".join(f"w{j}xx next{j}" for j in range(k, k + 500))) for i, k in enumerate([0, 500] * 20)]
    rows = [r for r in rows if not held(r[0])]
    test = [i for i in range(1000, 3000) if held(i)][:60]
    rows += [(i, f"w{j}xx next{j if k else 999 - j}") for i, (j, k) in zip(test, [(j, k) for j in range(10, 310, 10) for k in (0, 1)])]
    out = {r["doc_id"]: r["score"] for r in py.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[b] > out[a] + 2 for a, b in zip(test[::2], test[1::2]))


@pytest.mark.parametrize(("many", "most"), [(py.MANY, py.HEAD_CONTEXTS), (40, 100), (1, 0)])
def test_cells_of_all_words(spark, docs, many, most):
    df = spark.createDataFrame([(i, t, held(i)) for i, t, _ in docs], "doc_id long, text string, held boolean").repartition(3)
    cells, totals = py.train_pairs(df, many=many, head=most)
    by = {r["key"]: r for r in cells.collect()}
    n, every = pairs_of(t for i, t, _ in docs if not held(i)), pairs_of(t for _, t, _ in docs)
    c, keys = Counter(), dict(zip(every, cell_of(*every), strict=True))
    for (_, w), k in n.items():
        c[w] += k
    assert by.keys() == set(keys.values()) and (totals["tokens"], totals["words"]) == (sum(n.values()), len(c))
    assert all((by[k]["n"], by[k]["c"]) == (n[p], c[p[1]]) and by[k]["score"] < 0 for p, k in keys.items())
    scores = [{(r["doc_id"], r["n_tokens"]): r["score"] for r in py.score_pairs(df, cells, totals, head=h).collect()} for h in (py.HEAD_PAIRS, 3000, 0)]
    for i, t, _ in docs:
        ws = [*words_of(t), ""]
        want = sum(by[keys[p]]["score"] for p in zip([py.START, *ws], ws))
        assert all(abs(s[i, len(ws)] - want) < 1e-6 for s in scores)


def test_probabilities_after_every_word_sum_to_one(spark):
    # Held texts have every pair of the words, and one that no text that is learned has.
    words = ["a", "b", "c", "d", "e", "f"]
    learned = [" ".join(words[(i * j + i) % 5] for j in range(30)) for i in range(40)]
    rows = [(i, t, False) for i, t in enumerate(learned)] + [(-1, " ".join(f"{u} {w}" for u in words for w in words), True), *((-2, w, True) for w in words), (-3, "", True)]
    for many in (py.MANY, 3):
        cells, totals = py.train_pairs(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), many=many)
        by = {r["key"]: 10 ** r["score"] for r in cells.collect()}
        assert totals["words"] == 6
        for u in [py.START, *words]:
            # Words, the end; "f" has what an unknown word has.
            assert abs(sum(by[k] for k in cell_of(*((u, w) for w in [*words, ""]))) - 1) < 1e-3


def test_large_words_are_seated_as_small_ones_and_contexts_need_not_be_sent(spark, docs):
    df = spark.createDataFrame([(i, t, held(i)) for i, t, _ in docs], "doc_id long, text string, held boolean")
    form = ((2, py.MANY, py.HEAD_CONTEXTS), (3, py.MANY, 50), (2, 30, py.HEAD_CONTEXTS), (5, 30, 0))
    a, e, b, c = ({r["key"]: r["score"] for r in py.train_pairs(df.repartition(n), many=m, head=h)[0].collect()} for n, m, h in form)
    assert all(abs(b[k] - c[k]) < 1e-9 for k in b) and all(abs(a[k] - e[k]) < 1e-9 for k in a)
    assert abs(np.mean([a[k] - b[k] for k in a])) < 0.01 and max(abs(a[k] - b[k]) for k in a) < 0.3


def test_few_bytes_are_shuffled(spark):
    # A row for each token and cell took 135 bytes a token to learn and 24 to score, when nothing is broadcast; 0.51 GB of texts then did not fit the disk.
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held"))

    def written():
        time.sleep(1)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = [written()]
        cells, totals = py.train_pairs(df, head=0)
        at.append(written())
        n = sum(r["n_tokens"] for r in py.score_pairs(df, cells, totals, head=0).collect())
        at.append(written())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (at[1] - at[0]) / n < 100 and (at[2] - at[1]) / n < 19


def test_packed_numbers_and_digests_of_words():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 1000):
        for x in (rng.integers(0, 1 << 64, n, np.uint64), rng.integers(-5, 5, n), rng.random(n), rng.random(n).astype(np.float32), rng.integers(0, 1 << 30, n).astype(np.int32)):
            assert (py.unpacked(py.packed(x), x.dtype.type) == x).all()
        x = np.sort(rng.integers(0, 1 << 64, n, np.uint64))
        assert (py.unpacked(py.packed(x, True), np.uint64, True) == x).all()
    # Lengths about those of eight bytes and of long words; bytes that differ in one place only, zeros at the end.
    words = ["", " ", *("a" * n for n in range(1, 40)), *("a" * n + "\0" for n in range(40)), *("a" * n for n in (255, 256, 257, 300, 5000)), *("b" + "a" * n for n in (7, 8, 255, 256, 4999))]
    ids = py.word_ids(pa.array(words, pa.large_string()))
    assert len(set(ids.tolist())) == len(set(words))
    some = pa.array([*words, "x"], pa.string())[3:]
    assert (py.word_ids(some)[:-1] == ids[3:]).all()


def test_sent_cells_are_found():
    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 64, 5000, np.uint64))
    for known in (keys[:0], keys[:1], keys[::2], np.arange(100, dtype=np.uint64)):
        place = py.Cells(known).find(np.append(keys, known))
        assert ((place >= 0) == np.isin(np.append(keys, known), known)).all() and (known[place[place >= 0]] == np.append(keys, known)[place >= 0]).all()


def test_texts_whose_cells_are_not_learned_are_refused(spark):
    df = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, held boolean")
    cells, totals = py.train_pairs(df)
    with pytest.raises(Exception, match="not among those learned"):
        py.score_pairs(spark.createDataFrame([(1, "a c")], "doc_id long, text string"), cells, totals).collect()


def test_last_steps_of_dishes_are_drawn_together(monkeypatch):
    # Each dish had a draw of its own for its last customers, which took most of the time of a sweep.
    sizes, real = [], py.binomial
    monkeypatch.setattr(py, "binomial", lambda n, p, u, v: (sizes.append(len(p)), real(n, p, u, v))[1])
    n = np.arange(65, 3065)
    py.seat(n, np.full(3000, 2.0), 0.7, py.mixed(np.arange(3000, dtype=np.uint64)))
    assert len(sizes) < 200


def test_inversion_with_several_numbers_of_trials():
    u = py.uniform(py.mixed(np.arange(3000, dtype=np.uint64)), 1)
    n, p = np.arange(3000) % 70, (np.arange(3000) % 101) / 100
    got = py.binomial(n, p, u, u)
    for k in np.unique(n):
        assert (got[n == k] == py.binomial(int(k), p[n == k], u[n == k], u[n == k])).all()
    for i in np.flatnonzero(p <= 0.5)[:200].tolist():
        x, pmf, below = 0, (1 - p[i]) ** n[i], 0.0
        while x < n[i] and u[i] > (below := below + pmf):
            pmf *= p[i] / (1 - p[i]) * (n[i] - x) / (x + 1)
            x += 1
        assert got[i] == x


def test_blocks_are_seated_together_with_the_same_results(spark, docs):
    df = spark.createDataFrame([(t, held(i)) for i, t, _ in docs], "text string, held boolean").repartition(2)
    a, b = ({r["key"]: r["score"] for r in py.train_pairs(df, together=k)[0].collect()} for k in (1, py.TOGETHER))
    assert a == b


def test_ordered():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 100_000):
        for x in (rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 50, n).astype(np.uint64), rng.integers(0, 50, n).astype(np.uint64) << np.uint64(58)):
            assert (x[py.ordered(x)] == np.sort(x)).all()
            low = rng.integers(0, 5, n).astype(np.uint64)
            by, want = py.ordered(x, low), np.lexsort((low, x))
            assert (x[by] == x[want]).all() and (low[by] == low[want]).all() and len(set(by.tolist())) == n
            assert all((a == b).all() for a, b in zip(py.numbered(x), np.unique(x, return_inverse=True), strict=True))
