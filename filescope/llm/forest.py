"""Approximate nearest neighbours by a forest of sorted hash prefixes.

Each tree hashes a vector to a long string of bits, the signs of its products with random directions, and holds the
strings sorted. A query descends to the longest prefix that it shares with strings of each tree; then all trees ascend
together, one bit at a time, until the strings that share the prefix are enough in all trees together. Those are its
candidates, compared by exact inner product.

In Spark a tree's sorted array is cut by its first bits into blocks, each a row group of one task. A first pass has
each block tell, for the queries that fall into it, how many of its strings share each longer prefix; their sums over
trees give each query's depth. A second pass sends each query to the blocks under its prefix of that depth, where the
candidates' products are computed, and only the nearest of each block leave it. Equal vectors are one entry, which
carries the least ids of its copies, so many copies of a vector are no hot block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filescope.llm.common import column, materialize, tidy, tune

TREES = 16
BITS = 24
#: Candidates wanted from all trees together, as a share of the vectors, a vector counted in each tree that has it.
#: Vectors without any structure need so large a share for a recall of 0.9; see the README.
SHARE = 1.25
#: Entries of a tree in a block.
BLOCK = 8192
SEED = 3


def directions(dim: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, trees * bits))


def strings(vectors: np.ndarray, where: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(n, trees) hash strings, the first sign the highest bit."""
    signs = (vectors @ where > 0).reshape(len(vectors), trees, bits)
    return (signs.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=2)


def clean(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v of the vectors that take part: not null or zero, of finite components, none null."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return column(batch, "v").flatten().to_numpy().reshape(-1, dim)


def _hashed(rows: DataFrame, dim: int, longest: float, trees: int, bits: int) -> DataFrame:
    """A row for each tree: tree, hash and the columns of `rows`. Largest inner products become nearest directions."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = directions(dim + 1, trees, bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dim)
            norm = (x * x).sum(axis=1)
            # An entry gets a component that makes all equally long; a query is only scaled.
            is_query = np.array(column(batch, "ids").is_null())
            rest = np.where(is_query, 0, np.sqrt(np.maximum(0, longest * longest - norm)))
            h = strings(np.column_stack([x, rest]), where, trees, bits)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(h[:, t]), *batch.columns], names=["tree", "hash", *names])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tidy(run), f"tree int, hash long, {types}")


def search(table: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, bits: int = BITS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each vector that meets `queries` (a condition on vec_id) the k nearest found.

    Nearest by inner product of the original vectors in double precision, ties to the smaller vec_id; never itself.
    Vectors that are null, zero or not finite take no part; nor do those of another length than most. Rows of one vec_id
    are one vector, the least by its components. Fewer than k others: all of them. Extra columns are not read. An empty table: no rows.
    """
    spark = table.sparkSession
    tune(spark)
    rows = clean(table, id_col, vec_col).filter("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).orderBy(F.desc("n"), "dim").first()
    dim, longest = (sizes["dim"], sizes["longest"]) if sizes else (1, 1.0)
    rows = rows.filter(F.size("v") == dim)
    # The k+1 least ids of equal vectors are all that a result can hold of them.
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    entries = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    asked = rows.filter(queries).select("v", "vec_id")
    want = max(trees * (k + 1), int(share * n))
    cut = max(0, min(bits, ceil(log2(max(1, n / block)))))
    # Blocks are at the depth where the wanted candidates are expected, or finer to hold no more than a block.
    cut = max(cut, min(bits, int(log2(max(1.0, trees * n / want)))))
    index = materialize(_hashed(entries.select("v", "ids"), dim, longest, trees, bits))
    questions = _hashed(asked.select("v", F.lit(None).cast("array<bigint>").alias("ids"), "vec_id"), dim, longest, trees, bits)
    questions = materialize(questions.drop("ids"))

    def prefix(depth: int):
        return F.shiftrightunsigned("hash", bits - depth)

    # Depths up to the blocks' by counts of blocks; longer ones are counted within blocks.
    sizes_of = index.groupBy("tree", prefix(cut).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    asked_of = questions.select("vec_id", "tree", "hash", F.explode(F.sequence(F.lit(0), F.lit(cut))).alias("depth"))
    asked_of = asked_of.withColumn("p", F.expr(f"shiftrightunsigned(hash, {bits} - depth)"))
    tops = sizes_of.select("tree", "p", "n", F.explode(F.sequence(F.lit(0), F.lit(cut))).alias("depth"))
    tops = tops.select("tree", "depth", F.expr(f"shiftrightunsigned(p, {cut} - depth)").alias("p"), "n")
    tops = tops.groupBy("tree", "depth", "p").agg(F.sum("n").alias("n"))
    shallow = asked_of.join(tops, ["tree", "depth", "p"]).select("vec_id", "depth", "n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries_, questions_ in _blocks(batches):
            own = np.sort(entries_.column("hash").to_numpy())
            if not questions_.num_rows or not len(own):
                continue
            q, ids = questions_.column("hash").to_numpy(), questions_.column("vec_id").combine_chunks()
            for depth in range(cut + 1, bits + 1):
                s = bits - depth
                lo = np.searchsorted(own, q >> s << s)
                found = np.searchsorted(own, ((q >> s) + 1) << s) - lo
                some = found > 0
                if not some.any():
                    break
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(some)), pa.array(np.full(some.sum(), depth, np.int32)), pa.array(found[some])], names=["vec_id", "depth", "n"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries_, questions_ in _blocks(batches):
            if not questions_.num_rows or not entries_.num_rows:
                continue
            h = entries_.column("hash").to_numpy()
            order = np.argsort(h, kind="stable")
            h = h[order]
            lists = entries_.column("ids").combine_chunks()
            at, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            x = entries_.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
            q = questions_.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            own, depth, hq = (questions_.column(c).to_numpy() for c in ("vec_id", "depth", "hash"))
            s = bits - depth
            lo, hi = np.searchsorted(h, hq >> s << s), np.searchsorted(h, ((hq >> s) + 1) << s)
            out: list[list[np.ndarray]] = [[], [], []]
            for i in range(len(q)):
                if hi[i] <= lo[i]:
                    continue
                score = np.einsum("ij,j->i", x[lo[i] : hi[i]], q[i])
                best = np.arange(len(score)) if len(score) <= k + 1 else np.flatnonzero(score >= np.partition(score, -(k + 1))[-(k + 1)])
                who = order[lo[i] : hi[i]][best]
                many = at[who + 1] - at[who]
                pos = np.repeat(at[who], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                ids, scores = flat[pos], np.repeat(score[best], many)
                keep = ids != own[i]
                ids, scores = ids[keep], scores[keep]
                top = np.lexsort((ids, -scores))[:k]
                for o, v in zip(out, (np.full(len(top), own[i]), ids[top], scores[top]), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    def together(entry_cols: list[str], asks: DataFrame) -> DataFrame:
        """Entries and questions of a block in one task, entries of a block split no further than by cut."""
        blank = index.select("tree", prefix(cut).alias("p"), F.lit(0).alias("kind"), "hash", *entry_cols, F.lit(None).cast("long").alias("vec_id"), F.lit(0).alias("depth"))
        for c in {"v", "ids"} - set(entry_cols):
            blank = blank.withColumn(c, F.lit(None).cast(index.schema[c].dataType))
        asks = asks.withColumn("ids", F.lit(None).cast("array<bigint>"))
        return blank.unionByName(asks.select(blank.columns)).repartition("tree", "p").sortWithinPartitions("tree", "p", "kind")

    ask = questions.select("tree", prefix(cut).alias("p"), F.lit(1).alias("kind"), "hash", F.lit(None).cast("array<double>").alias("v"), "vec_id", F.lit(0).alias("depth"))
    deep = together([], ask).select("tree", "p", "kind", "hash", "vec_id").mapInArrow(tidy(count), "vec_id long, depth int, n long")
    totals = shallow.unionByName(deep).groupBy("vec_id", "depth").agg(F.sum("n").alias("n"))
    depths = totals.groupBy("vec_id").agg(F.coalesce(F.max(F.when(F.col("n") >= want, F.col("depth"))), F.lit(0)).alias("depth"))
    # A query whose depth is above the blocks' goes to all blocks under its prefix.
    sent = questions.join(depths, "vec_id")
    first = F.expr(f"shiftleft(shiftrightunsigned(hash, {bits} - least(depth, {cut})), {cut} - least(depth, {cut}))")
    blocks = F.sequence(first, first + F.expr(f"shiftleft(1L, {cut} - least(depth, {cut})) - 1"))
    sent = sent.select("tree", F.explode(blocks).alias("p"), F.lit(1).alias("kind"), "hash", "v", "vec_id", "depth")
    found = together(["v", "ids"], sent).mapInArrow(tidy(nearest), "query_id long, vec_id long, score double")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(entries, questions) of each block; rows come sorted by tree, prefix and kind."""
    held: list[pa.RecordBatch] = []
    now = None

    def done():
        t = pa.Table.from_batches(held)
        split = int((t.column("kind").to_numpy() == 0).sum())
        return t.slice(0, split), t.slice(split)

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, p = column(batch, "tree").to_numpy(), column(batch, "p").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(tree) != 0) | (np.diff(p) != 0)) + 1).tolist(), len(p)]
        for a, b in zip(edges, edges[1:], strict=False):
            key = int(tree[a]), int(p[a])
            if held and key != now:
                yield done()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield done()
