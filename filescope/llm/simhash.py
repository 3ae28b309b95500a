"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and verified Hamming distance.

Only distinct fingerprints are compared, so exact copies cost nothing. With m blocks and a distance of d, two close
fingerprints agree in at least m-d blocks: there is a table for each choice of m-d blocks, keyed by their bits, and m
follows from the number of fingerprints so that few far ones meet. A bucket of close fingerprints is never expanded
into pairs: the task that verifies it yields a spanning star for each group in it. Buckets over a bound are split into
chunks, and each pair of chunks is verified by a task of its own, so nothing is dropped and no task grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, lower_words, materialize, rows, text_and_id, text_tag, tidy, tune, utf8
from filescope.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of a bucket that one task compares at once; larger buckets are split.
BUCKET = 4096


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """A text's 64 bits: a bit is set if it is in over half the hashes of its shingles, which count each time."""
    words = lower_words(data)
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    first, last = (end - size)[:n].tolist(), (end[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        count += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag, fp: each text's fingerprint as a signed long, and its tag."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])

    def each(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(utf8(t), shingle) for t in column(batch, "text").to_pylist()], np.uint64)
        return {"doc_id": column(batch, "doc_id"), "tag": column(batch, "tag"), "fp": found.view(np.int64)}

    tagged = text_and_id(docs, id_col, text_col).select("doc_id", text_tag(F.col("text")).alias("tag"), "text")
    return tagged.mapInArrow(lambda it: rows(it, schema, each), "doc_id long, tag long, fp long")


def masks(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks of which close fingerprints agree under one at least; the more fingerprints, the more bits they have."""
    want = log2(max(n, 2))
    blocks = next((m for m in range(distance + 2, 2 * distance + 1) if 64 * (m - distance) / m >= want), 2 * distance + 1)
    edge = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) - (1 << 64 if sum(c) >> 63 else 0) for c in combinations(own, blocks - distance)]


def stars(found: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(member, centre) links that join exactly what chains of close pairs among `found` join: fewer than it has members."""
    if len(found) == 2:
        return [(int(found[1]), int(found[0]))] if (int(found[0] ^ found[1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance else []
    left, out = found.view(np.uint64), []
    while len(left) > 1:
        centre, front, left = left[:1].view(np.int64)[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 64):
                rest = np.flatnonzero(~near)
                near[rest] = (np.bitwise_count(left[rest, None] ^ front[None, i : i + 64]) <= distance).any(axis=1)
            front, left = left[near], left[~near]
            out += [(int(x), int(centre)) for x in front.view(np.int64)]
    return out


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the fingerprints of `distinct` (fp) that connect what close pairs connect."""
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(n, distance))))
    keyed = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    # Written, so that the join's sides are two exchanges: Spark can then split the tasks of a large bucket.
    size = materialize(keyed.groupBy("t", "key").count().filter("count > 1"))
    met = keyed.join(size, ["t", "key"])
    # Chunk c of k goes to each pair of chunks that has c, so that any two fingerprints of the bucket meet.
    chunks = F.ceil(F.col("count") / bucket)
    chunk = F.pmod(F.xxhash64("fp"), chunks)
    met = met.select("t", "key", "fp", chunk.alias("c"), F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))).alias("d"))
    lists = met.groupBy("t", "key", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).agg(F.sort_array(F.collect_list("fp")).alias("fps"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "fps")
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = [p for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a > 1 for p in stars(flat[a:b], distance)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return lists.select("fps").mapInArrow(tidy(verify), "a long, b long")


def fingerprint_classes(found: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """fp, root, component_id of each distinct fingerprint of `found` (doc_id, fp): root is the least linked fingerprint."""
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), distinct.count(), distance, bucket))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links reach, itself included.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other. Repeated rows: a row each,
    in one component. Null ids keep their rows, and are a component's id only if it has no other. Extra columns are not
    read. An empty table: no rows.
    """
    found = materialize(fingerprints(docs, id_col, text_col, shingle).select("doc_id", "fp"))
    classes = fingerprint_classes(found, distance, bucket)
    return found.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs`, all columns, of one document of each component: that with the least id, nulls last.

    Of different texts with that id (or without any) the least by hash stays; of rows that repeat with the same id and
    text, one.
    """
    found = materialize(fingerprints(docs, id_col, text_col, shingle))
    classes = fingerprint_classes(found, distance, bucket)
    own = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tag")
    kept = found.join(classes, "fp").groupBy("root").agg(F.min(own).alias("kept")).select(F.col("kept.doc_id").alias("_kept"), F.col("kept.tag").alias("_of"))
    keyed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_h": text_tag(F.col(text_col))})
    return keyed.join(kept, keyed["_id"].eqNullSafe(kept["_kept"]) & (keyed["_h"] == kept["_of"]), "left_semi").dropDuplicates(["_id", "_h"]).select(docs.columns)
