import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from filescope.llm import periodic


def brute(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = set()
    seen = {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                seen.setdefault((i, j + p - i), p)  # least period first
            i = max(j, i + 1)
    runs = sorted((s, length, p) for (s, length), p in seen.items())
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    return (
        doc_id, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "a " * 7 + "b", "A a " * 5, "ab " * 3000, "é x " * 9, "x\x1fy\x0bz " * 40]
    for _ in range(300):
        alphabet = "abcdefghij"[: rng.randint(1, 10)]
        words = []
        while len(words) < rng.randint(1, 120):
            if rng.random() < 0.3:
                unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 9))]
                words += (unit * rng.randint(2, 7))[: rng.randint(1, 60)]
            else:
                words.append(rng.choice(alphabet))
        out.append(" ".join(words))
    a, b = "a", "ab"
    for _ in range(10):  # a Fibonacci word is full of runs, but of few periods each
        a, b = b, b + a
    out.append(" ".join(b))
    out.append(" ".join(" ".join(f"w{i}" for i in range(700)) for _ in range(5)))
    return out


COLUMNS = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_against_brute_force(spark):
    data = [(i, t, 7) for i, t in enumerate(texts())] + [(None, "a b " * 9, 7), (3, texts()[20], 7), (3, "c " * 30, 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, start int")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in periodic.periodic_runs(df.repartition(3)).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t, _ in data), key=repr)
    assert any(r[2] > 1 for r in got)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_extensions_in_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 60, 50)
    at = np.concatenate([[0], np.cumsum(sizes)])
    codes = rng.integers(0, 2, at[-1])
    whole = periodic.find_runs(codes, at)
    monkeypatch.setattr(periodic, "AT_ONCE", 70)
    assert (periodic.find_runs(codes, at) == whole).all() and len(whole)
    assert len(periodic.find_runs(np.zeros(0, np.int64), np.array([0]))) == 0


def test_runs_and_words_kept(spark):
    df = spark.createDataFrame([(1, "so it goes on and on and on and on and on it went")], "doc_id long, text string")
    r = periodic.periodic_runs(df).first()
    assert [tuple(x) for x in r["runs"]] == [(3, 9, 2)] and r["exponent_milli"] == 4500 and r["n_kept"] == 7
