"""Periodic runs of words: Karp-Miller-Rosenberg names of power-of-two lengths, and extensions by descending names.

A name of level k stands for the 2^k words from a place on: places of one text have the same name where those words are
the same. Level k+1 names pairs of names of level k, so that all levels come from sorting pairs of integers, all texts
of an Arrow batch at once. A place whose name no other place of its text has is left out of the levels above: natural
text runs out of repeated names after a few of them.

A run of period p holds, in its first p words, a place i of the grid of multiples of p that agrees with i+p for over 2p
words. Grid places with the same name as the place p further on, at the level that 2p words reach, are extended forwards
and backwards by descending levels. What is longer than four periods is a run; of equal stretches the least period counts.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from filescope.llm.common import column, rows, text_and_id, tune, word_table

#: Periods in a run, and words in it, at least.
TIMES, LEAST = 4, 6
#: Candidates that are extended at once.
AT_ONCE = 1 << 20

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
    + [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_kept", pa.int64())]
)
DDL = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string, n_kept long"


def order_of_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """The number of the word that stands at each place, where the contract rewrites the text; None where it does not."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and whether another place has it too."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return name.astype(np.int32), count[name] > 1


def levels(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Names by level of all places of texts, which lie one after the other from at[d] on; the last level has no repeats.

    A place without a partner, or with too few words left, has a negative name of its own.
    """
    n = len(codes)
    alone = -1 - np.arange(n, dtype=np.int32)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    name, again = _named(doc * (int(codes.max()) + 1 if n else 1) + codes)
    out, width = [np.where(again, name, alone)], 1
    while True:
        low = out[-1]
        place = np.flatnonzero(low >= 0)
        place = place[place + 2 * width <= n]
        place = place[(low[place + width] >= 0) & (doc[place] == doc[place + 2 * width - 1])]
        if not len(place):
            return out
        name, again = _named(low[place].astype(np.int64) * n + low[place + width])
        up = alone.copy()
        up[place[again]] = name[again]
        if not again.any():
            return out
        out.append(up)
        width *= 2


def agree(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """For how many words the places from a on and from b on agree; with `back`, the places before them."""
    n, total = len(names[0]), np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step = 1 << k
        x, y = (a - total - step, b - total - step) if back else (a + total, b + total)
        inside = (x >= 0) if back else (y < n)
        same = inside.copy()
        same[inside] = names[k][x[inside]] == names[k][y[inside]]
        total += step * same
    return total


def grid(at: np.ndarray, docs: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): for periods of first..last, every place of these texts at a multiple of the period."""
    size = np.diff(at)[docs]
    most = np.minimum(last, size // TIMES)
    docs, size, most = (x[most >= first] for x in (docs, size, most))
    each = most - first + 1
    period = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + first
    begin, size = np.repeat(at[docs], each), np.repeat(size, each)
    count = (size - 1) // period  # the place one period on lies in the text
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    period = np.repeat(period, count)
    return np.repeat(begin, count) + step * period, period


def find_runs(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of all texts, by start, then period; places count through all texts."""
    names = levels(codes, at)
    found = []
    for k in range(len(names) - 1):
        # Periods of 2^k to 2^(k+1)-1, whose runs agree for 2^(k+1) words at a grid place.
        docs = np.unique(np.searchsorted(at, np.flatnonzero(names[k + 1] >= 0), side="right") - 1)
        size = np.cumsum(np.diff(at)[docs])
        for part in np.split(docs, np.searchsorted(size, np.arange(AT_ONCE, size[-1], AT_ONCE)) if len(docs) else []):
            place, period = grid(at, part, 1 << k, (2 << k) - 1)
            same = names[k + 1][place] == names[k + 1][place + period]
            place, period = place[same], period[same]
            start = place - agree(names, place, place + period, True)
            end = place + period + agree(names, place, place + period, False)
            full = (end - start >= TIMES * period) & (end - start >= LEAST)
            found.append(np.unique(np.stack([start[full], end[full], period[full]], 1), axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _each(batch: pa.RecordBatch) -> dict:
    words, at = word_table(column(batch, "text"), lower=False)
    ids = column(batch, "doc_id").to_pylist()
    which = np.arange(len(words))
    for d, ident in enumerate(ids):
        order = order_of_words(ident, int(at[d + 1] - at[d]))
        if order is not None:
            which[at[d] : at[d + 1]] = at[d] + order
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)[which]
    runs = find_runs(codes, at)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone[:-1]) == 0
    kept_at = np.concatenate([[0], np.cumsum(kept)])[at]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_at, pa.int32()), words.take(pa.array(which[kept]))), pa.scalar(" ", words.type))
    edge = np.searchsorted(runs[:, 0], at)
    out: dict[str, list] = {f.name: [] for f in SCHEMA}
    for d, ident in enumerate(ids):
        own = [(s - int(at[d]), e - s, p) for s, e, p in runs[edge[d] : edge[d + 1]].tolist()]
        # min() keeps the first of equals, and these come by start, then period.
        best = min(own, key=lambda r: -Fraction(r[1], r[2])) if len(own) > 1 else own[0] if own else (None, None, None)
        digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if own else None
        values = (ident, int(at[d + 1] - at[d]), len(own), *best, milli, [{"start": s, "length": n, "period": p} for s, n, p in own], digest, hashlib.sha256(joined[d].as_buffer()).hexdigest(), int(kept_at[d + 1] - kept_at[d]))
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_runs, the run of most periods, all runs, digests of the runs and of the words kept.

    Words are compared byte by byte; texts with ids whose CRC-32 ends in 0 are first rewritten as order_of_words() says,
    those without an id are not. A run has TIMES periods and LEAST words at least. Of runs with as many periods the first
    by start, then period, is reported. Null, empty and blank texts: no words, no runs, nulls for the run, digests of
    nothing. Repeated rows: a row each. Extra columns are not read. An empty table: no rows. No row meets another: one
    stage, no shuffle; a task holds an Arrow batch's words, four bytes a word and level (the log of the longest repeat).
    """
    tune(docs.sparkSession)
    return text_and_id(docs, id_col, text_col).mapInArrow(lambda it: rows(it, SCHEMA, _each), DDL)
