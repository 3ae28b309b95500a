"""A hierarchical Pitman-Yor language model over words, and log probabilities of texts under it.

The restaurant of a context has the words that follow it as dishes. The context is the word before, whatever word that is,
or the start of a text. All context restaurants share one parent, the restaurant of all words, whose base is uniform over
the vocabulary and one unknown word: a table in a context's restaurant is a customer of the parent.

Seating is sampled by blocked Gibbs sweeps: a sweep takes each dish's customers of each restaurant out and seats them
anew, one at a time, by the Chinese-restaurant probabilities given all else. Given the restaurants' totals, dishes are
independent, so each word's row is sampled where it lies and only totals (a few numbers a context) meet, once a round.
After burn-in, each sweep is a sample, and a text's probability is by the samples' averaged predictive probabilities.
Random numbers are hashes of the word, the context, the sweep and the customer, so that they do not depend on which rows
a task has. A cell is a word after a context, with its count. The totals of contexts with most cells, of a
bounded number, are sent to all tasks; those of all others meet their cells by a join. Cells are dealt by word; a word with
more than MANY tokens is dealt over tasks, and its count in the parent then is as the round before left it, as the
restaurants' totals are. Words and cells are told apart by 64 bits. Cells of whole words lie together in blocks, a row
each, of compressed numbers.

To score, the cells with most tokens, of a bounded number, are sent to all tasks; for tokens of all other cells a chunk of
texts asks where these are, by bucket of their digests. Both give the same probabilities.

A smaller model (`own_contexts`) has a bounded number of contexts: the corpus' most common words, and CLASSES classes (a hash
of the last two bytes; class 0 is the start of a text) that all other words before share. There words with most tokens are
sent, and a probability is by each sample's tables, not by their mean.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, discard, materialize, text_and_id, text_tag, tidy, tune, word_table

#: Of the smaller model: words that are contexts of their own, and classes of the others; together no more than 1 << SHIFT.
OWN, CLASSES, SHIFT = 224, 32, 12
#: As many contexts have numbers of SHIFT bits.
MOST_OWN = (1 << SHIFT) - CLASSES
LISTED = 1 << 14
#: The token after the last word; no word is empty.
END = ""
ROUNDS, BURN_IN, SAMPLES = 1, 2, 4
CONCENTRATION = 1.0
#: What bounds the broadcast: most words, of which length in bytes, with how many cells; words with a dense row each.
HEAD, HEAD_BYTES, HEAD_CELLS, DENSE = 1 << 17, 48, 1 << 24, 8192
#: Cells and contexts that are broadcast at most; a word with more tokens than MANY is dealt over tasks.
HEAD_PAIRS, HEAD_CONTEXTS, MANY = 1 << 22, 1 << 21, 1 << 19
#: Rows and cells that a task works on at once.
GATHER = 1 << 16
#: Numbers that are drawn by inversion at once, dishes that are seated at once, and cells of which blocks are seated together.
INVERTED, SEATED, TOGETHER = 1 << 12, 1 << 15, 1 << 19
#: The context at the start of a text; no word has a space.
START = " "
SEED = 7
#: Bytes of text, and cells of whole words, that a task works on at once; buckets of digests a task; bytes of long words.
CHUNK, BLOCK, PER_TASK, LONG = 8 << 20, 1 << 18, 4, 256
_G, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: The low bytes of eight.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_ids(words: pa.Array) -> np.ndarray:
    """64-bit digests of words, eight bytes at a time."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    start, left = offsets[:-1] - offsets[0], np.diff(offsets)
    out = left.astype(np.uint64) * _G
    at = None
    for _ in range(LONG // 8):
        x = eight[start] & _LOW[np.minimum(left, 8)]
        h = ((out if at is None else out[at]) ^ x) * _M1
        h ^= h >> np.uint64(32)
        if at is None:
            out, at = h, np.flatnonzero(left > 8)
            start, left = start[at] + 8, left[at] - 8
        else:
            out[at] = h
            more = left > 8
            at, start, left = at[more], start[more] + 8, left[more] - 8
        if not len(at):
            break
    for i in at.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(words[i].as_py(), digest_size=8).digest(), "little")
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def draw(key: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """The k-th number of 53 bits of each key, which is a hash already."""
    x = key + (k.astype(np.uint64) * _G if isinstance(k, np.ndarray) else np.uint64(k * int(_G) & (1 << 64) - 1))
    x *= _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x >>= np.uint64(11)
    return x


def uniform(key: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """The k-th number between 0 and 1 of each key."""
    return (draw(key, k) + np.float64(0.5)) * 2.0**-53


def binomial(n: int | np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Successes of n trials of probability p from uniform u: by inversion, or normal (with v) where 32 or more are expected."""
    q = np.minimum(p, 1 - p)
    mean = n * q
    wide = mean >= 32
    if not wide.any() and len(q) <= INVERTED:
        out = inverted(n, q, u)
        return np.where(p > 0.5, n - out, out)
    out, n = np.zeros(len(q)), np.broadcast_to(n, len(q))
    z = np.sqrt(-2 * np.log(u[wide])) * np.cos(2 * np.pi * v[wide])
    out[wide] = np.clip(np.rint(mean[wide] + z * np.sqrt(mean[wide] * (1 - q[wide]))), 0, n[wide])
    at = np.flatnonzero(~wide)
    for i in range(0, len(at), INVERTED):
        some = at[i : i + INVERTED]
        out[some] = inverted(n[some], q[some], u[some])
    return np.where(p > 0.5, n - out, out)


def inverted(n: int | np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Successes of n trials of probability q by inversion: how many of 0 .. n-1 have a cumulative probability under u.

    Some rows of these probabilities are made at once, enough for most of u.
    """
    at, k, out = slice(None), 0, np.zeros(len(q))
    pmf, below, odds = (1 - q) ** n, 0.0, q / (1 - q)
    top = float((n * q).max(initial=0))
    width = int(top + 2 * top**0.5) + 2
    while len(u):
        j = np.arange(k, k + width)[:, None]
        rows = np.empty((width + 1, len(u)))
        rows[0] = pmf
        np.multiply(odds, np.maximum(n - j, 0) / (j + 1), out=rows[1:])
        np.multiply.accumulate(rows, axis=0, out=rows)
        sums = rows[:-1]
        pmf = rows[-1]
        sums[0] += below
        np.add.accumulate(sums, axis=0, out=sums)
        over = u > sums
        out[at] += over.sum(axis=0)
        k += width
        more = np.flatnonzero(over[-1] & (k < n))
        at = more if isinstance(at, slice) else at[more]
        pmf, below, odds, u, n = pmf[more], sums[-1][more], odds[more], u[more], n[more] if np.ndim(n) else n
        width = 16
    return out


def classes_of(words: pa.Array) -> np.ndarray:
    """The class of a following token's context for each word: 1 .. CLASSES-1. 0 is the start of a text."""
    ends = pc.binary_slice(words.cast(pa.large_binary()), -2, None).dictionary_encode()
    classes = np.array([1 + zlib.crc32(e) % (CLASSES - 1) for e in ends.dictionary.to_pylist()] or [0], np.int64)
    return classes[ends.indices.to_numpy()] if len(words) else np.empty(0, np.int64)


def tokens(texts: pa.Array, own: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, each token's word, each token's context, each text's offsets); every text ends with END.

    The i-th of `own` is context CLASSES + i.
    """
    words, at = word_table(texts)
    coded = words.dictionary_encode()
    distinct = pa.concat_arrays([coded.dictionary.cast(pa.large_string()), pa.array([END], pa.large_string())])
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    word = np.full(len(words) + n, len(distinct) - 1, np.int64)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner] = coded.indices.to_numpy()
    named = pc.fill_null(pc.index_in(distinct[:-1], own), -1).to_numpy().astype(np.int64)
    after = np.where(named < 0, classes_of(distinct[:-1]), named + CLASSES)
    ctx = np.zeros(len(word), np.int64)
    ctx[1:] = np.append(after, 0)[word[:-1]]
    offsets = at + np.arange(n + 1)
    ctx[offsets[:-1]] = 0
    return distinct, word, ctx, offsets


def common_words(docs: DataFrame, most: int = OWN) -> list[str]:
    """The most common words of `docs` (text), as contexts of their own: ties by the word.

    Every two million tokens give their LISTED most common words, so that a word at the border may be counted short.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            words, _ = word_table(column(batch, "text"))
            pairs = words.value_counts()
            held.append(pa.table({"word": pairs.field("values"), "n": pairs.field("counts")}))
            size += len(words)
            if size > 2_000_000:
                yield from best(held)
                held, size = [], 0
        if held:
            yield from best(held)

    def best(parts: list[pa.Table]) -> list[pa.RecordBatch]:
        t = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        t = t.sort_by([("n_sum", "descending"), ("word", "ascending")]).slice(0, max(LISTED, most))
        t = t.filter(pc.less_equal(pc.binary_length(t.column("word")), HEAD_BYTES))
        return pa.table({"word": t.column("word").cast(pa.string()), "n": t.column("n_sum")}).to_batches()

    found = docs.select("text").mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(most).collect()]


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHER) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _lists(values: pa.Array, row: np.ndarray, n: int) -> pa.Array:
    """Values by their rows, in order, as a list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the row of each."""
    lists = t.column(name).combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(at))


def count_words(docs: DataFrame, own: list[str]) -> DataFrame:
    """word, cells: a row per distinct token of `docs` (text), with its count in each context as count << SHIFT | context."""
    schema = pa.schema([("word", pa.string()), ("cells", pa.list_(pa.int64()))])
    low = (1 << SHIFT) - 1

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["word", "ctx"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "ctx", "n"])

    def as_rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = t.column("word").combine_chunks().dictionary_encode()
        word, cells = coded.indices.to_numpy(), t.column("n").to_numpy() << SHIFT | t.column("ctx").to_numpy()
        by = np.lexsort((cells & low, word))
        batch = pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), _lists(pa.array(cells[by]), word[by], len(coded.dictionary))], schema=schema)
        for i in range(0, batch.num_rows, GATHER):
            yield batch.slice(i, GATHER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(own, pa.large_string())
        held, size = [], 0
        for batch in batches:
            distinct, word, ctx, _ = tokens(column(batch, "text"), names)
            key, n = np.unique(word << SHIFT | ctx, return_counts=True)
            held.append(pa.table({"word": distinct.take(pa.array(key >> SHIFT)), "ctx": key & low, "n": n}))
            size += len(key)
            if size > 2_000_000:
                yield from as_rows(summed(held))
                held, size = [], 0
        if held:
            yield from as_rows(summed(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word: all words but the last are complete, and that one's cells are no more than contexts."""
        rest: list[pa.Table] = []
        for t in gathered(batches):
            cells, row = _flat(t, "cells")
            words = t.column("word").combine_chunks().cast(pa.large_string())
            last = words[-1]
            all_ = summed([*rest, pa.table({"word": words.take(pa.array(row)), "ctx": cells & low, "n": cells >> SHIFT})])
            open_ = pc.equal(all_.column("word"), last)
            rest = [all_.filter(open_)]
            done = all_.filter(pc.invert(open_))
            if done.num_rows:
                yield from as_rows(done)
        for t in rest:
            yield from as_rows(t)

    types = "word string, cells array<long>"
    return docs.select("text").mapInArrow(tidy(count), types).repartition("word").sortWithinPartitions("word").mapInArrow(tidy(merge), types)


def seat(count: np.ndarray, new: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables after seating `count` customers of a dish one at a time; `new` is the weight of a new table.

    From the 64th customer on, a 32nd of those seated so far sit down under the same probability. Random by `key`.
    """
    order = np.argsort(-count, kind="stable")
    c, a, key, t = count[order], new[order], key[order], (count[order] > 0).astype(np.float64)
    falling, last = -c, []
    for i in range(0, int(np.searchsorted(falling, -1, "left")), SEATED):
        some = slice(i, i + SEATED)
        few, tables, weight, keys = falling[some], t[some], a[some], key[some]
        room, least = weight - discount * tables, weight * 2.0**53
        for n in range(1, 64):
            live = int(np.searchsorted(few, -n, "left"))
            if not live:
                break
            # A number of 53 bits is below weight / (n - discount * tables + weight).
            x = (room[:live] + n) * draw(keys[:live], n).view(np.int64)
            new_table = x < least[:live]
            tables[:live] += new_table
            room[:live] -= discount * new_table
    n = 64
    while live := int(np.searchsorted(falling, -n, "left")):
        p = a[:live] / (n - discount * t[:live] + a[:live])
        step = n // 32
        full = int(np.searchsorted(falling[:live], -n - step, "right"))
        if full:
            u = uniform(key[:full], n)
            # Of fewer trials than 64, no more than 32 successes are expected.
            t[:full] += binomial(step, p[:full], u, uniform(key[:full] ^ _M1, n) if step >= 64 else u)
        # A smaller step is the last of its dish, so that those of all dishes can be taken together.
        last.append((np.arange(full, live), np.full(live - full, n), p[full:]))
        n += step
    if last:
        at, begun, p = map(np.concatenate, zip(*last, strict=True))
        t[at] += binomial(c[at] - begun, p, uniform(key[at], begun), uniform(key[at] ^ _M1, begun))
    out = np.empty_like(t)
    out[order] = t
    return out


def sample(t: pa.Table, totals: dict, discounts: tuple[float, float], sweeps: int, keep: int, first: int) -> tuple[np.ndarray, ...]:
    """(row, ctx, count, tables of the last `keep` sweeps) of each cell, and each word's customers and tables in the parent.

    `first` is the number of the first sweep.
    """
    cells, row = _flat(t, "cells")
    ctx, count = cells & ((1 << SHIFT) - 1), (cells >> SHIFT).astype(np.float64)
    ids = word_ids(t.column("word").combine_chunks())
    weight = (CONCENTRATION + discounts[0] * totals["tables"])[ctx]
    return row, ctx, count, *sit(ids, row, count, weight, ctx.astype(np.uint64), totals, discounts, sweeps, keep, first)


def sit(ids: np.ndarray, row: np.ndarray, count: np.ndarray, weight: np.ndarray, ctx: np.ndarray, totals: dict, discounts: tuple[float, float], sweeps: int, keep: int, first: int, fixed: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Tables of each cell, and each word's customers and tables in the parent, in the last `keep` sweeps.

    A cell is of word `row`, in context `ctx` (numbers that tell contexts apart) whose new tables weigh `weight`. `fixed`
    has the customers and tables in the parent of words (else nan) of which not all cells are here.
    """
    open_ = np.flatnonzero(count > 1)
    single = np.bincount(row[count == 1], minlength=len(ids))
    got, root, root_tables = sit_open(ids, single, row[open_], count[open_], weight[open_], ctx[open_], totals, discounts, sweeps, keep, first, fixed)
    tables = np.ones((keep, len(count)))
    tables[:, open_] = got
    return tables, root, root_tables


def sit_open(ids: np.ndarray, single: np.ndarray, row: np.ndarray, count: np.ndarray, weight: np.ndarray, ctx: np.ndarray, totals: dict, discounts: tuple[float, float], sweeps: int, keep: int, first: int, fixed: tuple | None = None) -> tuple[np.ndarray, ...]:
    """sit() of cells with two customers or more; `single` has how many cells with one customer each word has besides."""
    d, d1 = discounts
    base = 1 / (totals["words"] + 1)
    # As seat() sorts them, so that it does not have to in each sweep.
    order = np.argsort(-count, kind="stable")
    row, count, weight = row[order], count[order], weight[order]
    keys = mixed(ids[row] ^ mixed(ctx[order] + np.uint64(SEED)))
    known = np.isnan(fixed[0]) if fixed is not None else np.ones(len(ids), bool)
    tables = np.ones(len(count))
    root, root_tables = single + np.bincount(row, tables, len(ids)), np.ones(len(ids))
    out = np.empty((keep, len(count)), np.int32), np.empty((keep, len(ids))), np.empty((keep, len(ids)))
    for k in range(sweeps):
        if fixed is not None:
            root, root_tables = np.where(known, root, fixed[0]), np.where(known, root_tables, fixed[1])
        sweep = mixed(np.array([first + k + 1], np.uint64))
        parent = np.maximum(root[row] - tables - d1 * root_tables[row], 0) + (CONCENTRATION + d1 * totals["root_tables"]) * base
        tables = seat(count, weight * parent / (CONCENTRATION + totals["root_customers"]), d, keys ^ sweep)
        root = single + np.bincount(row, tables, len(ids))
        root_tables = seat(root, np.full(len(ids), (CONCENTRATION + d1 * totals["root_tables"]) * base), d1, ids ^ sweep)
        if k >= sweeps - keep:
            i = k - sweeps + keep
            out[0][i, order], out[1][i], out[2][i] = tables, root, root_tables
    return out


def ney(n1: int, n2: int) -> float:
    """A discount by how many dishes have one customer and how many have two."""
    return min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


def train(docs: DataFrame, own: list[str], rounds: int = ROUNDS, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[DataFrame, dict, tuple[float, float]]:
    """(words, totals, discounts) from all rows of `docs` (text). words: word, c, root, root_tables, cells.

    root and root_tables have a number for each sample; cells has, for each context the word follows, ctx, n (its count)
    and t (mean tables). `totals` has customers of contexts and, for each sample, their tables, and those of the parent.
    No rows: an empty model.
    """
    tune(docs.sparkSession)
    contexts, sweeps = CLASSES + len(own), burn_in + samples
    counted = materialize(count_words(docs, own))
    x = F.col("x")
    cell = counted.select(F.explode("cells").alias("x")).select(F.shiftright(x, SHIFT).alias("n"), x.bitwiseAND((1 << SHIFT) - 1).alias("ctx"))
    by_ctx = cell.groupBy("ctx").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()
    totals = {"customers": np.zeros(contexts), "tables": np.zeros(contexts)}
    for r in by_ctx:
        totals["customers"][r["ctx"]], totals["tables"][r["ctx"]] = r["n"], r["t"]
    size = F.size("cells")
    w = counted.agg(F.count(F.lit(1)).alias("v"), F.count_if(size == 1).alias("n1"), F.count_if(size == 2).alias("n2")).first()
    totals |= {"words": float(w["v"]), "root_customers": float(totals["tables"].sum()), "root_tables": float(w["v"])}
    discounts = ney(sum(r["n1"] for r in by_ctx), sum(r["n2"] for r in by_ctx)), ney(w["n1"], w["n2"])

    def totalled(batches: Iterator[pa.RecordBatch], now: dict, k: int) -> Iterator[pa.RecordBatch]:
        tables, root, seen = np.zeros(contexts), 0.0, 0.0
        for t in gathered(batches):
            _, ctx, _, all_, r, rt = sample(t, now, discounts, sweeps, samples, k * sweeps)
            tables += np.bincount(ctx, all_.mean(axis=0), contexts)
            root, seen = root + r.mean(axis=0).sum(), seen + rt.mean(axis=0).sum()
        yield pa.RecordBatch.from_arrays([pa.array([*range(contexts), contexts, contexts + 1]), pa.array([*tables, root, seen])], names=["k", "x"])

    for k in range(rounds):
        found = counted.mapInArrow(lambda it, now=totals, k=k: totalled(it, now, k), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        x = {r["k"]: r["x"] for r in found}
        totals = totals | {"tables": np.array([x.get(i, 0.0) for i in range(contexts)]), "root_customers": x.get(contexts, 0.0), "root_tables": x.get(contexts + 1, 0.0)}
    fields = pa.struct([("ctx", pa.int32()), ("n", pa.int64()), ("t", pa.float32())])
    lists = pa.list_(pa.float32())
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("root", lists), ("root_tables", lists), ("cells", pa.list_(fields))])

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words' rows and, at a task's end, a row without a word for each sample: what the task adds to its totals."""
        tables, root_sums = np.zeros((samples, contexts)), np.zeros((2, samples))
        for t in gathered(batches):
            row, ctx, count, all_, root, root_tables = sample(t, totals, discounts, sweeps, samples, rounds * sweeps)
            n = t.num_rows
            values = pa.StructArray.from_arrays([pa.array(ctx, pa.int32()), pa.array(count.astype(np.int64)), pa.array(all_.mean(axis=0), pa.float32())], fields=list(fields))
            per_word = [pa.FixedSizeListArray.from_arrays(pa.array(x.T.astype(np.float32).ravel()), samples).cast(lists) for x in (root, root_tables)]
            out = [t.column("word").combine_chunks(), pa.array(np.bincount(row, count, n).astype(np.int64)), *per_word, _lists(values, row, n)]
            yield pa.RecordBatch.from_arrays(out, schema=schema)
            for s in range(samples):
                tables[s] += np.bincount(ctx, all_[s], contexts)
            root_sums += [root.sum(axis=1), root_tables.sum(axis=1)]
        added = [[{"ctx": i, "n": 0, "t": t} for i, t in enumerate(row.tolist())] for row in tables]
        sums = [[[x] for x in row.tolist()] for row in root_sums]
        yield pa.RecordBatch.from_arrays([pa.nulls(samples, pa.string()), pa.array(range(samples), pa.int64()), pa.array(sums[0], lists), pa.array(sums[1], lists), pa.array(added, pa.list_(fields))], schema=schema)

    types = "word string, c long, root array<float>, root_tables array<float>, cells array<struct<ctx:int,n:long,t:float>>"
    seats = materialize(counted.mapInArrow(tidy(seated), types))
    discard(counted)
    parts = seats.filter("word is null")
    now = {"tables": np.zeros((samples, contexts)), "root_customers": np.zeros(samples), "root_tables": np.zeros(samples)}
    for r in parts.select("c", F.explode("cells").alias("x")).groupBy("c", "x.ctx").agg(F.sum(F.col("x.t").cast("double")).alias("t")).collect():
        now["tables"][r["c"], r["ctx"]] = r["t"]
    for r in parts.groupBy("c").agg(F.sum(F.col("root")[0].cast("double")).alias("a"), F.sum(F.col("root_tables")[0].cast("double")).alias("b")).collect():
        now["root_customers"][r["c"]], now["root_tables"][r["c"]] = r["a"], r["b"]
    return seats.filter("word is not null"), totals | now, discounts


def _weights(totals: dict, discounts: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """1 / (customers and concentration) of each context; for each sample, the share a context leaves to the parent.

    Then for each sample the same two of the parent, per customer and per word of the vocabulary.
    """
    d, d1 = discounts
    scale = 1 / (CONCENTRATION + totals["customers"])
    root = 1 / (CONCENTRATION + totals["root_customers"])
    return scale, (CONCENTRATION + d * totals["tables"]) * scale, root, (CONCENTRATION + d1 * totals["root_tables"]) * root / (totals["words"] + 1)


def _heaviest(words: DataFrame, head: int) -> F.Column:
    """Which words are sent to all tasks: those with most tokens, of at most `head` words and HEAD_CELLS cells."""
    level, short = F.floor(F.log2("c") * 16), F.octet_length("word") <= HEAD_BYTES
    least, n, cells = None, 0, 0
    for r in words.filter(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("cells")).orderBy(F.desc("level")).collect():
        n, cells = n + r["n"], cells + r["cells"]
        if n > head or cells > HEAD_CELLS:
            break
        least = r["level"]
    return short & (level >= least) if least is not None else F.lit(False)


class Head:
    """The probabilities of the most common words, as a task has them: a dense row for the first, cells for the others."""

    def __init__(self, x: dict, scale: np.ndarray, rest: np.ndarray) -> None:
        """x: names, base, p1 of the words, and by (word, context) sorted keys and `own`, customers less discounts."""
        self.names, self.base, self.p1, self.rest = pa.array(x["names"], pa.large_string()), x["base"], x["p1"], rest
        self.contexts, self.dense = len(scale), min(DENSE, len(x["names"]))
        self.keys, self.logs = x["keys"], np.empty(len(x["keys"]), np.float32)
        for i in range(0, len(self.keys), GATHER):
            row, ctx = np.divmod(self.keys[i : i + GATHER], self.contexts)
            self.logs[i : i + GATHER] = np.log10(x["own"][i : i + GATHER] * scale[ctx] + self._rest(row, ctx))
        first = int(np.searchsorted(self.keys, self.dense * self.contexts))
        self.table = np.log10(np.maximum(self.p1[:, : self.dense].T @ rest / len(rest), 1e-300)).astype(np.float32).ravel()
        self.table[self.keys[:first]] = self.logs[:first]
        self.keys, self.logs = self.keys[first:], self.logs[first:]

    def _rest(self, row: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        return sum(r[ctx] * p[row] for r, p in zip(self.rest, self.p1, strict=True)) / len(self.rest)

    def score(self, row: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; `row` is its word's place among the names."""
        key = (row * self.contexts + ctx).astype(np.int32)
        out = np.empty(len(row))
        often = row < self.dense
        out[often] = self.table[key[often]]
        at = np.flatnonzero(~often)
        if len(at):
            own = key[at]
            i = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
            hit = self.keys[i] == own if len(self.keys) else np.zeros(len(own), bool)
            out[at[hit]] = self.logs[i[hit]]
            none = at[~hit]
            out[none] = np.log10(self._rest(row[none], ctx[none]))
        return out


def score(docs: DataFrame, own: list[str], words: DataFrame, totals: dict, discounts: tuple[float, float], head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of `docs` (doc_id, text); logarithms to base 10.

    n_known and base_score are by unigram counts with 0.1 added. Rows that repeat get a row each.
    """
    spark = docs.sparkSession
    d, d1 = discounts
    scale, rest, root, base_mass = _weights(totals, discounts)
    total, v = float(totals["customers"].sum()), totals["words"]
    norm = np.log10(total + 0.1 * (v + 1))
    in_head = _heaviest(words, head)
    value = F.transform("cells", lambda x: F.struct(x["ctx"], (x["n"] - F.lit(d) * x["t"]).cast("float").alias("own")))
    top = words.filter(in_head).select("word", "c", "root", "root_tables", F.array_sort(value).alias("cells")).orderBy(F.desc("c"), "word").toArrow()
    flat = lambda name: np.asarray(pc.list_flatten(top.column(name)).to_numpy(), np.float64).reshape(-1, len(root)).T
    keys, value, n = [np.empty(0, np.int32)], [np.empty(0, np.float32)], 0
    for part in top.column("cells").chunks:
        row = n + np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
        keys.append((row * len(scale) + part.flatten().field(0).to_numpy()).astype(np.int32))
        value.append(part.flatten().field(1).to_numpy())
        n += len(part)
    p1 = (flat("root") - d1 * flat("root_tables")) * root[:, None] + base_mass[:, None]
    sent = {"names": top.column("word").to_pylist(), "base": np.log10(top.column("c").to_numpy() + 0.1) - norm, "p1": p1}
    del top, flat
    shipped = spark.sparkContext.broadcast(sent | {"keys": np.concatenate(keys), "own": np.concatenate(value)})
    del keys, value, p1, sent
    loaded: list[Head] = []
    fields = [("doc_id", pa.int64()), ("tag", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.string()), ("ctx", pa.int32())]
    schema = pa.schema(fields)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what its head words give, and one for each other token."""
        if not loaded:
            loaded.append(Head(shipped.value, scale, rest))
        known, contexts = loaded[0], pa.array(own, pa.large_string())
        for batch in batches:
            n = batch.num_rows
            distinct, word, ctx, at = tokens(column(batch, "text"), contexts)
            ids = pc.fill_null(pc.index_in(distinct, known.names), -1).to_numpy().astype(np.int64)[word]
            doc = np.repeat(np.arange(n), np.diff(at))
            hit = ids >= 0
            sums = [np.bincount(doc[hit], x, n) for x in (None, known.base[ids[hit]], known.score(ids[hit], ctx[hit]))]
            ident, tag = column(batch, "doc_id"), column(batch, "tag")
            # No word has a space: these rows meet no word, and are dealt evenly.
            none = pa.array([f" {i}" for i in ident.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([ident, tag, pa.array(np.diff(at)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), none, pa.nulls(n, pa.int32())], schema=schema)
            miss = np.flatnonzero(~hit)
            for i in range(0, len(miss), GATHER):
                some = miss[i : i + GATHER]
                at_doc = pa.array(doc[some])
                empty = [pa.nulls(len(some), t) for _, t in fields[2:6]]
                yield pa.RecordBatch.from_arrays([ident.take(at_doc), tag.take(at_doc), *empty, distinct.take(pa.array(word[some])).cast(pa.string()), pa.array(ctx[some].astype(np.int32))], schema=schema)

    keyed = docs.select("doc_id", text_tag(F.col("text")).alias("tag"), "text")
    rows = keyed.mapInArrow(tidy(look_up), "doc_id long, tag long, n_tokens long, known long, base double, score double, word string, ctx int")
    each_p1 = [(F.col("root")[s] - F.lit(d1) * F.col("root_tables")[s]) * float(root[s]) + float(base_mass[s]) for s in range(len(root))]
    tail = words.filter(~in_head).select(F.col("word").alias("w"), "c", F.array(*each_p1).alias("p1"), "cells")
    joined = rows.join(tail, rows["word"] == tail["w"], "left")
    at = F.col("ctx") + 1
    values = lambda x: F.array(*map(F.lit, x.tolist()))
    mine = F.get(F.filter("cells", lambda x: x["ctx"] == F.col("ctx")), F.lit(0))
    cell = F.coalesce((mine["n"] - F.lit(d) * mine["t"]) * F.element_at(values(scale), at), F.lit(0.0))
    shares = [F.element_at(values(r), at) * F.coalesce(F.col("p1")[s], F.lit(float(base_mass[s]))) for s, r in enumerate(rest)]
    p = cell + sum(shares[1:], shares[0]) / len(shares)
    token = F.col("ctx").isNotNull()
    out = joined.select(
        "doc_id",
        "tag",
        F.when(token, 0).otherwise(1).alias("n_rows"),
        "n_tokens",
        F.when(token, F.col("c").isNotNull().cast("long")).otherwise(F.col("known")).alias("known"),
        F.when(token, F.log10(F.coalesce("c", F.lit(0)) + 0.1) - float(norm)).otherwise(F.col("base")).alias("base"),
        F.when(token, F.log10(p)).otherwise(F.col("score")).alias("score"),
    )
    return _each_text(out)


def _each_text(parts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: sums of a text's parts; n_rows is how many rows have the text."""
    sums = parts.groupBy("doc_id", "tag").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_tokens", "known", "base", "score")))
    # Rows that repeat have met: each gets its share.
    each = sums.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    whole = [F.expr(f"{c} div n_rows").cast("long").alias(a) for c, a in (("n_tokens", "n_tokens"), ("known", "n_known"))]
    return each.select("doc_id", *whole, (F.col("base") / F.col("n_rows")).alias("base_score"), (F.col("score") / F.col("n_rows")).alias("score"))


def cell_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit digests of cells by the digests of context and word."""
    return mixed(mixed(u) ^ w).view(np.int64)


def token_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of each token's context and word, and each text's offsets; every text ends with END."""
    words, at = word_table(texts)
    offsets = at + np.arange(len(at))
    inner = np.ones(len(words) + len(at) - 1, bool)
    inner[offsets[1:] - 1] = False
    end, start = word_ids(pa.array([END, START], pa.large_string()))
    w = np.full(len(inner), end, np.uint64)
    ids = np.empty(len(words), np.uint64)
    for i in range(0, len(words), GATHER):
        ids[i : i + GATHER] = word_ids(words[i : i + GATHER])
    w[inner] = ids
    u = np.roll(w, 1)
    u[offsets[:-1]] = start
    return u, w, offsets


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as compressed bytes, all first bytes before all second ones; ascending ones by their differences."""
    if ascending and len(x):
        x = np.append(x[:1], np.diff(x))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(pa.py_buffer(planes), asbytes=True)


def unpacked(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(pa.py_buffer(data)[8:], n * width), np.uint8) if n else np.empty(0, np.uint8)
    x = np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)
    return np.cumsum(x, dtype=kind) if ascending else x


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with some CHUNK bytes of text at a time, one at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def only(t: pa.Table, name: str) -> pa.Array:
    x = t.column(name)
    return x.chunk(0) if x.num_chunks == 1 else pa.concat_arrays(x.chunks)


def as_batches(rows: list[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + size], strict=True), schema, strict=True)], schema=schema)


def as_dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def bucket_count(df: DataFrame) -> int:
    return PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(digests: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of ascending digests that have any, and where these are."""
    if not len(digests):
        return
    of = (digests >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    found, first = np.unique(of, return_index=True)
    for b, i, j in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
        yield b, slice(i, j)


def dealt(df: DataFrame, buckets: int, *order: str) -> DataFrame:
    """Rows by `bucket`, PER_TASK consecutive ones a task."""
    return df.repartitionById(buckets // PER_TASK, F.floor(F.col("bucket") / PER_TASK).cast("int")).sortWithinPartitions("bucket", *order)


_SUMS = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("x", pa.binary())])
_SUM_TYPES = "bucket int, key binary, x binary"


def ordered(key: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Places that sort rows by 64-bit keys, then by `low`.

    Numbers sort several times as fast as places, so places go into the keys' last bits; where these decide, rows are sorted again.
    """
    bits = np.uint64(len(key).bit_length())
    x = key >> bits
    x <<= bits
    x |= np.arange(len(key), dtype=np.uint64)
    x.sort()
    by = (x & (np.uint64(1) << bits) - np.uint64(1)).view(np.int64)
    full = key[by]
    wrong = full[1:] < full[:-1]
    if low is not None:
        less = low[by]
        wrong |= (full[1:] == full[:-1]) & (less[1:] < less[:-1])
    if wrong.any():
        x >>= bits
        group = np.cumsum(np.append(0, x[1:] != x[:-1]))
        again = np.zeros(group[-1] + 1, bool)
        again[group[1:][wrong]] = True
        at = np.flatnonzero(again[group])
        rows = by[at]
        by[at] = rows[np.lexsort((key[rows],) if low is None else (low[rows], key[rows]))]
    return by


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct numbers, and the place of each of `x` among them."""
    by = ordered(x)
    x = x[by]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    at = np.empty(len(x), np.int32)
    at[by] = np.cumsum(new) - 1
    return x[new], at


def added_up(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, and the sums of the rows of `x`."""
    by = ordered(keys)
    keys = keys[by]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(x[:, by], start, axis=1) if len(start) else x[:, :0]


def sums_by_key(df: DataFrame, each, also: DataFrame | None = None) -> DataFrame:
    """bucket, key, x: sums by 64-bit key of the (keys, rows of numbers) that `each` makes of batches, and of the frame `also`."""
    buckets = bucket_count(df)

    def as_rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, x = added_up(np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held], axis=1))
        yield from as_batches([(b, packed(keys[at], True), packed(x[:, at].ravel())) for b, at in slices(keys, buckets)], _SUMS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for keys, x in each(batches):
            held.append(added_up(keys, x))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield from as_rows(held)
                held, size = [], 0
        if held:
            yield from as_rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in groupby(as_dicts(batches), lambda r: r["bucket"]):
            keys, x = added_up(*(np.concatenate(y, axis=-1) for y in zip(*map(keyed, rows), strict=True)))
            yield from as_batches([(b, packed(keys, True), packed(x.ravel()))], _SUMS)

    parts = df.mapInArrow(tidy(make), _SUM_TYPES)
    return dealt(parts.unionByName(also) if also is not None else parts, buckets).mapInArrow(tidy(merge), _SUM_TYPES)


def keyed(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """The keys and numbers of a row of sums_by_key()."""
    keys = unpacked(r["key"], np.uint64, True)
    return keys, unpacked(r["x"], np.float64).reshape(-1, len(keys)) if len(keys) else np.empty((0, 0))


#: Cells of whole words: the words' digests (or those of parts of words that are dealt) with their numbers of cells, and
#: for each cell the place of its context among the ascending `us`, and its count. `t` has tables, all samples' together.
_BLOCK = pa.schema([("block", pa.int64()), ("w", pa.binary()), ("size", pa.binary()), ("us", pa.binary()), ("at", pa.binary()), ("n", pa.binary())])
_BLOCK_TYPES = "block long, w binary, size binary, us binary, at binary, n binary"


class Dealt:
    """Words that are dealt over tasks: each part has a digest of its own."""

    def __init__(self, sizes: dict[int, int], many: int) -> None:
        self.words = np.array(sorted(sizes), np.uint64)
        self.parts = np.array([-(-sizes[w] // many) for w in self.words.tolist()], np.uint64)
        # Parts are numbered from 1.
        number = np.concatenate([np.arange(1, p + 1, dtype=np.uint64) for p in self.parts.tolist()] or [np.empty(0, np.uint64)])
        whole = np.repeat(self.words, self.parts.astype(np.int64))
        ids = mixed(whole + number * _G)
        by = np.argsort(ids)
        self.ids, self.whole = ids[by], whole[by]

    def deal(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """`w`, or of words that are dealt the digest of the part for context `u`."""
        i = _places(self.words, w)
        at = np.flatnonzero(i >= 0)
        out = w.copy()
        out[at] = mixed(w[at] + (mixed(u[at]) % self.parts[i[at]] + np.uint64(1)) * _G)
        return out

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whole words, which of `w` are parts)."""
        i = _places(self.ids, w)
        out = w.copy()
        out[i >= 0] = self.whole[i[i >= 0]]
        return out, i >= 0


def _places(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of `x` among the ascending `known`; -1: not there."""
    if not len(known):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[i] == x, i, -1)


def _cells(r: dict) -> tuple[np.ndarray, ...]:
    """(words, each cell's row, contexts, each cell's place among these, counts) of a block."""
    w = unpacked(r["w"], np.uint64)
    return w, np.repeat(np.arange(len(w)), unpacked(r["size"], np.int32)), unpacked(r["us"], np.uint64, True), unpacked(r["at"], np.int32), unpacked(r["n"], np.int64)


def count_pairs(docs: DataFrame, many: int = MANY) -> tuple[DataFrame, Dealt]:
    """Blocks of the cells of `docs` (text, held), each with its count in texts that are not held, which may be 0.

    A word with more than `many` tokens in all texts is dealt: each part has some `many` tokens.
    """

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in chunks(batches):
            ids = np.sort(token_ids(only(t, "text"))[1])
            start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            yield ids[start], np.diff(np.append(start, len(ids)))[None].astype(np.float64)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in as_dicts(batches):
            keys, (k,) = keyed(r)
            yield pa.RecordBatch.from_arrays([pa.array(keys[k > many].view(np.int64)), pa.array(k[k > many].astype(np.int64))], names=["w", "n"])

    sizes = sums_by_key(docs.select("text"), occur).mapInArrow(tidy(above), "w long, n long").collect()
    large = Dealt({r["w"] & (1 << 64) - 1: r["n"] for r in sizes}, many)
    buckets = bucket_count(docs)
    schema = pa.schema([("bucket", pa.int32()), ("w", pa.binary()), ("size", pa.binary()), ("u", pa.binary()), ("n", pa.binary())])
    high = np.uint64(32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            u, w, at = token_ids(only(t, "text"))
            w = large.deal(u, w)
            learned = np.repeat(~only(t, "held").to_numpy(zero_copy_only=False), np.diff(at))
            # By halves of the digests: cells that these do not tell apart may come twice, and are added up later.
            by = np.argsort(w >> high << high | u >> high)
            u, w, seen = u[by], w[by], np.append(0, np.cumsum(learned[by]))
            start = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (u[1:] != u[:-1])))
            n = np.diff(seen[np.append(start, len(w))])
            u, w = u[start], w[start]
            out = []
            for b, i in slices(w, buckets):
                first = np.flatnonzero(np.append(True, w[i][1:] != w[i][:-1]))
                out.append((b, packed(w[i][first]), packed(np.diff(np.append(first, len(w[i]))).astype(np.int32)), packed(u[i]), packed(n[i])))
            yield from as_batches(out, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in groupby(as_dicts(batches), lambda r: r["bucket"]):
            parts = [(unpacked(r["w"], np.uint64), unpacked(r["size"], np.int32), unpacked(r["u"], np.uint64), unpacked(r["n"], np.int64)) for r in rows]
            w, size, u, n = map(np.concatenate, zip(*parts, strict=True))
            del parts
            words, w = numbered(w)
            w = np.repeat(w, size)
            # By the word's place and as many bits of the context as fit beside it, then by the context.
            bits = np.uint64(len(words).bit_length())
            by = ordered(w.astype(np.uint64) << np.uint64(64) - bits | u >> bits, u)
            w, u, n = w[by], u[by], n[by]
            start = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (u[1:] != u[:-1])))
            w, u, n = words[w[start]], u[start], np.add.reduceat(n, start)
            first = np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])), len(w))
            i, k = 0, 0
            while i < len(first) - 1:
                j = max(i + 1, int(np.searchsorted(first, first[i] + BLOCK, "right")) - 1)
                cells = slice(first[i], first[j])
                us, at = numbered(u[cells])
                yield from as_batches([(b << 24 | k, packed(w[first[i:j]]), packed(np.diff(first[i : j + 1]).astype(np.int32)), packed(us, True), packed(at), packed(n[cells]))], _BLOCK)
                i, k = j, k + 1

    found = docs.select("text", "held").mapInArrow(tidy(count), "bucket int, w binary, size binary, u binary, n binary")
    return materialize(dealt(found, buckets).mapInArrow(tidy(merge), _BLOCK_TYPES)), large


class Contexts:
    """Customers and tables of the contexts with most cells, of a bounded number, as a task has them."""

    def __init__(self, frame: DataFrame, most: int, seated: bool = False) -> None:
        """frame: customers, cells, and tables beyond one a cell, by context. `whole` is whether all of its contexts are here.

        With `seated`, only contexts with a cell of two customers or more count: elsewhere there is nothing to seat.
        """

        def some(r: dict, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, x = keyed(r)
            level = np.floor(np.log2(np.maximum(x[1], 1)) * 16)
            at = (level >= least) & ((x[0] > x[1]) | (not seated))
            return keys[at], x[:, at], level[at].astype(np.int64)

        def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in as_dicts(batches):
                level, n = np.unique(some(r, 0)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n)], names=["level", "n"])

        least, n, self.whole = None, 0, True
        for r in frame.mapInArrow(tidy(levels), "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
            n += r["n"]
            if n > most:
                self.whole = False
                break
            least = r["level"]
        self.u, self.customers, self.tables = np.empty(0, np.uint64), np.empty(0), np.empty(0)
        if least is None:
            return

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in as_dicts(batches):
                keys, x, _ = some(r, least)
                yield from as_batches([(r["bucket"], packed(keys, True), packed(x.ravel()))], _SUMS)

        rows = [keyed(r) for r in as_dicts(frame.mapInArrow(tidy(keep), _SUM_TYPES).toArrow().to_batches())]
        rows = [r for r in rows if len(r[0])]
        u, x = np.concatenate([k for k, _ in rows]), np.concatenate([x for _, x in rows], axis=1)
        by = np.argsort(u)
        self.u, self.customers, self.tables = u[by], x[0][by], (x[1] + x[2])[by]

    def find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(customers, tables, which contexts are here); both are 0 elsewhere."""
        i = _places(self.u, u)
        here = i >= 0
        customers, tables = np.zeros(len(u)), np.zeros(len(u))
        customers[here], tables[here] = self.customers[i[here]], self.tables[i[here]]
        return customers, tables, here


def context_rows(frame: DataFrame) -> DataFrame:
    """u, customers, tables: a row for each context."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in as_dicts(batches):
            u, x = keyed(r)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(x[0]), pa.array(x[1] + x[2])], names=["u", "customers", "tables"])

    return frame.mapInArrow(tidy(expand), "u long, customers double, tables double")


#: Frames of cells, each with a function that makes (keys, counts, words' counts, scores) of its batches.
Sources = list[tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]]]


def learn(docs: DataFrame, rounds: int = ROUNDS, burn_in: int = BURN_IN, samples: int = SAMPLES, many: int = MANY, head: int = HEAD_CONTEXTS, together: int = TOGETHER) -> tuple[Sources, dict, list[DataFrame]]:
    """(cells, totals, what to discard after them) from `docs` (text, held).

    Cells of held texts only are among them, with count 0. `totals` has the numbers of tokens and of words. Probabilities are
    by the mean tables of the last round's samples. A word with more than `many` tokens is dealt over tasks. At most `head`
    contexts' totals are broadcast; those of all others meet their cells by a join. Blocks with `together` cells to seat are
    seated in one run, with the same results whatever their number.
    """
    spark = docs.sparkSession
    tune(spark)
    (pairs, large), sweeps = count_pairs(docs, many), burn_in + samples

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells and tokens of words that are dealt (1), other sums (2 to 4)."""
        sums = np.zeros((3, 2), np.int64)
        for r in as_dicts(batches):
            w, size, n = unpacked(r["w"], np.uint64), unpacked(r["size"], np.int32), unpacked(r["n"], np.int64)
            row = np.repeat(np.arange(len(w)), size)
            whole, part = large.find(w)
            cells, tokens = (np.bincount(row[n > 0], x, len(w)).astype(np.int64) for x in (None, n[n > 0]))
            one = ~part & (tokens > 0)
            sums += [[n.sum(), one.sum()], [(n == 1).sum(), (n == 2).sum()], [(cells[one] == 1).sum(), (cells[one] == 2).sum()]]
            yield rows_of(whole[part], cells[part], tokens[part], 1)
        for i in range(3):
            yield rows_of(np.zeros(1, np.uint64), sums[i, :1], sums[i, 1:], 2 + i)

    def rows_of(ids: np.ndarray, a: np.ndarray, b: np.ndarray, what: int) -> pa.RecordBatch:
        cols = [pa.array(ids.view(np.int64)), pa.array(a.astype(np.float64)), pa.array(b.astype(np.float64)), pa.array(np.full(len(ids), what, np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "a", "b", "what"])

    def sums_of(df: DataFrame, run) -> dict:
        found = df.mapInArrow(tidy(run), "id long, a double, b double, what int").groupBy("what", "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        return {(r["what"], r["id"] & (1 << 64) - 1): (r["a"], r["b"]) for r in found.collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Customers and cells of contexts."""
        for r in as_dicts(batches):
            us, at, n = unpacked(r["us"], np.uint64, True), unpacked(r["at"], np.int32), unpacked(r["n"], np.int64)
            cells = np.bincount(at[n > 0], minlength=len(us))
            x = np.array([np.bincount(at, n, len(us)), cells, np.zeros(len(us))])
            yield us[cells > 0], x[:, cells > 0]

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Tables that contexts have beyond one a cell."""
        for r in as_dicts(batches):
            us, at, t = unpacked(r["us"], np.uint64, True), unpacked(r["at"], np.int32), unpacked(r["t"], np.int32) / samples
            more = np.bincount(at[t > 1], t[t > 1] - 1, len(us))
            x = np.zeros((3, len(us)))
            x[2] = more
            yield us[more > 0], x[:, more > 0]

    sums = sums_of(pairs.select("w", "size", "n"), stats)
    (n, v), cell12, word12 = (sums.get((k, 0), (0.0, 0.0)) for k in (2, 3, 4))
    # Words that are dealt: customers and tables in the parent are as the round before left them.
    fixed = {w: [cells, float(c > 0), int(c)] for (what, w), (cells, c) in sums.items() if what == 1}
    ones = [x[0] for x in fixed.values() if x[2]]
    word12 = word12[0] + ones.count(1), word12[1] + ones.count(2)
    v += len(ones)
    d, d1 = discounts = ney(*cell12), ney(*word12)
    first_contexts = contexts = materialize(sums_by_key(pairs.select("us", "at", "n"), counted))

    def customers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum((keyed(r)[1][1].sum() for r in as_dicts(batches)), 0.0)])], names=["x"])

    dishes = contexts.mapInArrow(tidy(customers), "x double").agg(F.sum("x").alias("x")).first()["x"] or 0.0
    totals = {"tokens": int(n), "words": v, "root_customers": dishes, "root_tables": v}
    seat_schema = pa.schema([*_BLOCK, ("t", pa.binary()), ("g", pa.binary()), ("root_tables", pa.binary())])

    def others(shipped, frame: DataFrame) -> DataFrame:
        """`pairs` and, of contexts that are not sent and have cells to seat, the tables."""
        if shipped.value.whole:
            return pairs

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in as_dicts(batches):
                us, at, n = unpacked(r["us"], np.uint64, True), unpacked(r["at"], np.int32), unpacked(r["n"], np.int64)
                seated = np.bincount(at[n > 1], minlength=len(us)) > 0
                u = us[seated & ~shipped.value.find(us)[2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), r["block"])), pa.array(u.view(np.int64))], names=["block", "u"])

        lists = pairs.select("block", "us", "at", "n").mapInArrow(tidy(far), "block long, u long").join(context_rows(frame).select("u", "tables"), "u")
        return pairs.join(lists.groupBy("block").agg(F.collect_list(F.struct("u", "tables")).alias("far")), "block", "left")

    def seated(batches: Iterator[pa.RecordBatch], now: dict, given: dict, first: int, shipped) -> Iterator[pa.RecordBatch]:
        """Each cell's tables and, of each word, customers less discounts and tables in the parent."""
        held, size = [], 0
        for r in as_dicts(batches):
            w, row, us, at, n = _cells(r)
            tables = shipped.value.find(us)[1]
            for x in r.get("far") or []:
                tables[np.searchsorted(us, np.uint64(x["u"] & (1 << 64) - 1))] = x["tables"]
            open_ = np.flatnonzero(n > 1)
            own = at[open_]
            held.append((r, w, np.bincount(row[n == 1], minlength=len(w)), row[open_], n[open_].astype(np.float64), CONCENTRATION + d * tables[own], us[own]))
            size += len(open_) + len(w)
            del row, us, at, n, tables, open_, own
            if size >= together:
                yield from seated_together(held, now, given, first)
                held, size = [], 0
        if held:
            yield from seated_together(held, now, given, first)

    def seated_together(held: list[tuple], now: dict, given: dict, first: int) -> Iterator[pa.RecordBatch]:
        """Several blocks, each in its own rows, in one run of the sweeps: a step takes its time whatever it seats."""
        rows, ws, *_ = zip(*held, strict=True)
        begin = np.cumsum([0, *map(len, ws)])
        w, single, row, count, weight, ctx = (np.concatenate([x[i] + begin[j] if i == 3 else x[i] for j, x in enumerate(held)]) for i in range(1, 7))
        cells = np.cumsum([0, *(len(x[3]) for x in held)])
        held.clear()
        whole, part = large.find(w)
        known = np.full((2, len(w)), np.nan)
        for i in np.flatnonzero(part):
            known[:, i] = given[int(whole[i])][:2]
        got, root, parent_tables = sit_open(whole, single, row, count, weight, ctx, now, discounts, sweeps, samples, first, known)
        got = got.sum(axis=0).astype(np.int32)
        root_tables = np.where(part, 0.0, parent_tables.mean(axis=0))
        g = root.mean(axis=0) - d1 * root_tables
        for j, r in enumerate(rows):
            n = unpacked(r["n"], np.int64)
            t = (n > 0).astype(np.int32) * np.int32(samples)
            t[n > 1] = got[cells[j] : cells[j + 1]]
            some = slice(begin[j], begin[j + 1])
            yield from as_batches([(*(r[f.name] for f in _BLOCK), packed(t), packed(g[some]), packed(root_tables[some]))], seat_schema)

    def all_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tables of words that are dealt (1), all and the parent's (2)."""
        sums = np.zeros(2)
        for r in as_dicts(batches):
            w, size, t = unpacked(r["w"], np.uint64), unpacked(r["size"], np.int32), unpacked(r["t"], np.int32) / samples
            whole, part = large.find(w)
            dealt_tables = np.bincount(np.repeat(np.arange(len(w)), size), t, len(w))[part]
            yield rows_of(whole[part], dealt_tables, np.zeros(len(dealt_tables)), 1)
            sums += [t.sum(), unpacked(r["root_tables"], np.float64).sum()]
        yield rows_of(np.zeros(1, np.uint64), sums[:1], sums[1:], 2)

    for k in range(rounds + 1):
        shipped = spark.sparkContext.broadcast(Contexts(contexts, head, seated=True))
        run = tidy(lambda it, now=totals, given=fixed, first=k * sweeps, shipped=shipped: seated(it, now, given, first, shipped))
        seats = materialize(others(shipped, contexts).mapInArrow(run, f"{_BLOCK_TYPES}, t binary, g binary, root_tables binary"))
        shipped.destroy()
        sums = sums_of(seats.select("w", "size", "t", "root_tables"), all_tables)
        if fixed:
            ids, root = np.array(list(fixed), np.uint64), np.array([sums[1, w][0] for w in fixed])
            new = np.full(len(ids), (CONCENTRATION + d1 * totals["root_tables"]) / (totals["words"] + 1))
            own = seat(np.rint(root), new, d1, mixed(ids + np.uint64(k)))
            fixed = {w: [r, float(t), x[2]] for (w, x), r, t in zip(fixed.items(), root, own, strict=True)}
        all_, parent = sums.get((2, 0), (0.0, 0.0))
        totals = totals | {"root_customers": all_, "root_tables": parent + sum(x[1] for x in fixed.values())}
        before, contexts = contexts, materialize(sums_by_key(seats.select("us", "at", "t"), beyond, first_contexts))
        discard(*[seats] * (k < rounds), *[before] * (k > 0))
    discard(pairs, first_contexts)
    sent = Contexts(contexts, head)
    shipped, dealt_words, whole = spark.sparkContext.broadcast(sent), fixed, sent.whole
    base_mass = (CONCENTRATION + d1 * totals["root_tables"]) / (totals["words"] + 1)
    parent_size = CONCENTRATION + totals["root_customers"]

    def each(r: dict) -> tuple[np.ndarray, ...]:
        """keys, counts, words' counts, customers less discounts, words' shares of the parent, contexts, places among them."""
        w, row, us, at, n = _cells(r)
        words, part = large.find(w)
        g, c = unpacked(r["g"], np.float64).copy(), np.bincount(row, n, len(w)).astype(np.int64)
        for i in np.flatnonzero(part):
            root, tables, c[i] = dealt_words[int(words[i])]
            g[i] = root - d1 * tables
        own = n - d * (unpacked(r["t"], np.int32) / samples)
        return cell_keys(us[at], words[row]).view(np.uint64), n, c[row], own, ((g + base_mass) / parent_size)[row], us, at

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Cells of contexts that are sent."""
        for r in as_dicts(batches):
            key, n, c, own, p1, us, at = each(r)
            customers, tables, here = shipped.value.find(us)
            score = np.log10((own + (CONCENTRATION + d * tables)[at] * p1) / (CONCENTRATION + customers)[at]).astype(np.float32)
            done = slice(None) if whole else here[at]
            yield key[done], n[done], c[done], score[done]

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in as_dicts(batches):
            key, n, c, own, p1, us, at = each(r)
            some = np.flatnonzero(~shipped.value.find(us)[2][at])
            cols = [pa.array(key[some].view(np.int64)), *(pa.array(x[some]) for x in (n, c, own, p1)), pa.array(us[at[some]].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "c", "own", "p1", "u"])

    cells, files = [(seats.select("w", "size", "us", "at", "n", "t", "g"), near)], [seats]
    if not whole:
        left = cells[0][0].mapInArrow(tidy(far), "key long, n long, c long, own double, p1 double, u long").join(context_rows(contexts), "u", "left")
        share = CONCENTRATION + F.lit(d) * F.coalesce("tables", F.lit(0.0))
        score = F.log10((F.col("own") + share * F.col("p1")) / (CONCENTRATION + F.coalesce("customers", F.lit(0.0)))).cast("float")
        cells.append((materialize(left.select("key", "n", "c", score.alias("score"))), by_rows))
        files.append(cells[1][0])
    discard(contexts)
    return cells, totals, files


def by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Cells by rows of key, n, c, score."""
    for t in gathered(batches, 1 << 18):
        yield tuple(only(t, a).to_numpy().view(k) for a, k in (("key", np.uint64), ("n", np.int64), ("c", np.int64), ("score", np.float32)))


def train_pairs(docs: DataFrame, **options) -> tuple[DataFrame, dict]:
    """(cells, totals) of learn(): key, n (count in training), c (that of the word), score (log10 probability)."""
    sources, totals, files = learn(docs, **options)

    def expand(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        for key, *x in make(batches):
            for i in range(0, len(key), GATHER):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + GATHER].view(np.int64)), *(pa.array(y[i : i + GATHER]) for y in x)], names=["key", "n", "c", "score"])

    frames = [df.mapInArrow(tidy(lambda it, make=make: expand(it, make)), "key long, n long, c long, score float") for df, make in sources]
    cells = materialize(reduce(DataFrame.unionByName, frames))
    discard(*files)
    return cells, totals


class Cells:
    """Cells that are sent, found by the first bits of their keys."""

    def __init__(self, keys: np.ndarray) -> None:
        """Keys ascend."""
        self.keys, self.shift = keys, np.uint64(64 - max(1, int(len(keys)).bit_length() - 1))
        ends = np.bincount((keys >> self.shift).view(np.int64), minlength=1 << 64 - int(self.shift))
        self.start = np.zeros(len(ends) + 1, np.int32)
        np.cumsum(ends, out=self.start[1:], dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places; -1: not there."""
        out = np.full(len(keys), -1, np.int32)
        for i in range(0, len(keys), GATHER):
            self._find(keys[i : i + GATHER], out[i : i + GATHER])
        return out

    def _find(self, keys: np.ndarray, out: np.ndarray) -> None:
        slot = (keys >> self.shift).view(np.int64)
        place, end = self.start[slot], self.start[slot + 1]
        open_ = np.flatnonzero(place < end)
        while len(open_):
            i = place[open_]
            known = self.keys[i]
            hit = known == keys[open_]
            out[open_[hit]] = i[hit]
            # Keys of a slot ascend.
            more = (known < keys[open_]) & (i + 1 < end[open_])
            open_ = open_[more]
            place[open_] += 1


_FLOW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("key", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])
_FLOW_TYPES = "bucket int, kind int, chunk long, key binary, x binary, y binary"
#: Cells, what a chunk of texts asks, and the chunk itself.
CELLS, ASKED, TEXTS = range(3)


def score_cells(docs: DataFrame, sources: Sources, totals: dict, head: int = HEAD_PAIRS) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of `docs` (doc_id, text), whose cells all are in `sources`.

    At most `head` cells are broadcast. The others are asked for: a chunk of texts sends the keys of their tokens, with the
    text's place in the chunk, to where these cells are, and gets sums by text.
    """
    buckets = bucket_count(docs)
    norm = float(np.log10(totals["tokens"] + 0.1 * (totals["words"] + 1)))
    level_of = lambda n: np.floor(np.log2(np.maximum(n, 1)) * 16).astype(np.int64)

    def levels(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        for _, n, *_ in make(batches):
            level, k = np.unique(level_of(n[n > 0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(k)], names=["level", "n"])

    def of_all(run, types: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.mapInArrow(tidy(lambda it, make=make: run(it, make)), types) for df, make in sources])

    least, n = np.inf, 0
    for r in of_all(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        n += r["n"]
        if n > head:
            break
        least = r["level"]
    in_head = lambda n: (n > 0) & (level_of(n) >= least)

    def keep(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        for key, n, c, score in make(batches):
            at = np.flatnonzero(in_head(n))
            at = at[ordered(key[at])]
            yield from as_batches([(0, CELLS, 0, packed(key[at], True), packed(c[at]), packed(score[at]))], _FLOW)

    top = [(unpacked(r["key"], np.uint64, True), unpacked(r["x"], np.int64), unpacked(r["y"], np.float32)) for r in as_dicts(of_all(keep, _FLOW_TYPES).toArrow().to_batches())]
    key, c, s = map(np.concatenate, zip(*top, strict=True)) if top else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.float32))
    del top
    by = np.argsort(key)
    counts, of = np.unique(c[by], return_inverse=True)
    sent = (key[by], np.log10(counts + 0.1) - norm, of.astype(np.int32), s[by])
    del key, c, s, by, of
    shipped = docs.sparkSession.sparkContext.broadcast(sent)
    del sent

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, count, logs = shipped.value
        cells, task = Cells(keys), TaskContext.get().partitionId()
        for i, t in enumerate(chunks(batches)):
            u, w, at = token_ids(only(t, "text"))
            n, own = t.num_rows, cell_keys(u, w).view(np.uint64)
            del u, w
            # Keys that ascend are found with less waiting for memory.
            by = ordered(own)
            own, doc = own[by], np.repeat(np.arange(n, dtype=np.int32), np.diff(at))[by]
            place = cells.find(own)
            found, miss = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            here, place = doc[found], place[found]
            sums = [np.bincount(here, x, n).astype(np.float64) for x in (None, base[count[place]], logs[place])]
            ident, tag = only(t, "doc_id"), only(t, "tag").to_numpy()
            ids = pc.fill_null(ident, 0).to_numpy().view(np.uint64)
            chunk = int(mixed(np.bitwise_xor.reduce(mixed(mixed(ids ^ mixed(tag.view(np.uint64))) + np.arange(n, dtype=np.uint64)), keepdims=True) ^ mixed(np.array([task << 32 | i], np.uint64))).view(np.int64)[0])
            null = ident.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            out = [(chunk % buckets, TEXTS, chunk, packed(np.concatenate([ids.view(np.int64), null, np.diff(at)])), packed(np.concatenate(sums)), len(miss).to_bytes(8, "little"))]
            own, doc = own[miss], doc[miss]
            out += [(b, ASKED, chunk, packed(own[j], True), packed(doc[j]), None) for b, j in slices(own, buckets)]
            yield from as_batches(out, _FLOW)

    def others(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def as_rows() -> Iterator[pa.RecordBatch]:
            key, c, score = map(np.concatenate, zip(*held, strict=True))
            by = ordered(key)
            key, c, score = key[by], c[by], score[by]
            yield from as_batches([(b, CELLS, 0, packed(key[i], True), packed(c[i]), packed(score[i])) for b, i in slices(key, buckets)], _FLOW)

        for key, n, c, score in make(batches):
            at = np.flatnonzero(~in_head(n))
            held.append((key[at], c[at], score[at]))
            size += len(at)
            if size > 1_000_000:
                yield from as_rows()
                held, size = [], 0
        if size:
            yield from as_rows()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a bucket come first its cells, then what is asked; chunks of texts pass by."""
        for _, rows in groupby(as_dicts(batches), lambda r: r["bucket"]):
            held, known = [], None
            for r in rows:
                if r["kind"] == CELLS:
                    held.append((unpacked(r["key"], np.uint64, True), unpacked(r["x"], np.int64), unpacked(r["y"], np.float32)))
                    continue
                if r["kind"] == TEXTS:
                    yield from as_batches([tuple(r[f.name] for f in _FLOW)], _FLOW)
                    continue
                if known is None:
                    if not held:
                        raise ValueError("a text's cells are not among those learned")
                    keys, c, score = map(np.concatenate, zip(*held, strict=True))
                    by = ordered(keys)
                    known, c, score = keys[by], c[by], score[by]
                    base, held = np.log10(c + 0.1) - norm, []
                place, doc = _places(known, unpacked(r["key"], np.uint64, True)), unpacked(r["x"], np.int32)
                if (place < 0).any():
                    raise ValueError("a text's cells are not among those learned")
                n = np.bincount(doc)
                at = np.flatnonzero(n)
                x = [n[at].astype(np.float64), *(np.bincount(doc, y)[at] for y in ((c > 0)[place], base[place], score[place]))]
                yield from as_batches([(r["bucket"], ASKED, r["chunk"], packed(at.astype(np.int32), True), packed(np.concatenate(x)), None)], _FLOW)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a chunk come first its texts, then the answers."""
        for _, rows in groupby(as_dicts(batches), lambda r: r["chunk"]):
            texts = next(rows)
            if texts["kind"] != TEXTS:
                raise ValueError("texts came in another order when a task was repeated")
            ids, null, n_tokens = unpacked(texts["key"], np.int64).reshape(3, -1)
            sums = unpacked(texts["x"], np.float64).reshape(3, -1).copy()
            missing = int.from_bytes(texts["y"], "little")
            for r in rows:
                at = unpacked(r["key"], np.int32, True)
                n, *x = unpacked(r["x"], np.float64).reshape(4, -1)
                sums[:, at] += x
                missing -= int(n.sum())
            if missing:
                raise ValueError("texts came in another order when a task was repeated")
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null > 0), pa.array(n_tokens), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    asked = docs.select("doc_id", text_tag(F.col("text")).alias("tag"), "text").mapInArrow(tidy(look_up), _FLOW_TYPES)
    answers = dealt(asked.unionByName(of_all(others, _FLOW_TYPES)), buckets, "kind").mapInArrow(tidy(answer), _FLOW_TYPES)
    met = answers.repartition(buckets // PER_TASK, "chunk").sortWithinPartitions("chunk", F.desc("kind"))
    return met.mapInArrow(tidy(together), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_pairs(docs: DataFrame, cells: DataFrame, totals: dict, head: int = HEAD_PAIRS) -> DataFrame:
    """score_cells() by the cells of train_pairs()."""
    return score_cells(docs, [(cells.select("key", "n", "c", "score"), by_rows)], totals, head)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own_contexts: int | None = None, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; a model of those not held out.

    A word's context is the word before it. With `own_contexts` it is that only where the word before is one of as many
    most common ones, else its class: a smaller model. Held out: crc32 of the id as text is divisible by 10; a null id
    counts as empty text, and is held out. Null texts are empty and have the end token only. Extra columns are not read.
    Without training texts every probability is 1. Rows may come in any order. An empty table: no rows. `own_contexts` is
    at most MOST_OWN.
    """
    if own_contexts is not None and not 0 <= own_contexts <= MOST_OWN:
        raise ValueError(f"own_contexts is between 0 and {MOST_OWN}")
    tune(docs.sparkSession)
    own = text_and_id(docs, id_col, text_col)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    if own_contexts is None:
        cells, totals, _ = learn(own.select("text", held.alias("held")))
        out, n = score_cells(own, cells, totals, **options), totals["tokens"]
    else:
        learned = own.filter(~held)
        contexts = common_words(learned, own_contexts)
        model = train(learned, contexts)
        out, n = score(own, contexts, *model, **options), int(model[1]["customers"].sum())
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
