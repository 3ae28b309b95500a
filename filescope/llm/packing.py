"""Best-fit packing of token sequences, with bound-certified repacking.

Texts are cut into pieces of at most `capacity` tokens. A piece of exactly that length is a sequence of its own. The
others are dealt into partitions of a bounded number of pieces; each partition packs its own by best-fit decreasing and
computes a lower bound of its sequences by dual feasible functions. Where the bound equals the count, the packing is
certified and stays. Partitions with a gap give the pieces of their sequences that aren't full to an exchange: these
pieces are dealt anew, into fewer partitions, and packed again, for some rounds.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, materialize, rows, text_and_id, tidy, tune

CAPACITY = 1024
END = 2
#: Pieces that one task packs at once: what bounds its memory.
PIECES_PER_TASK = 100_000
ROUNDS = 3


@lru_cache(1)
def _encoding():
    """The byte-level BPE of byte_bpe_50k.json, run from the same vocabulary's ranks, which takes a third of the time."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A text is encoded in parts of about so many characters, cut where no token of any text crosses.
PART = 1 << 16


def encode(text: str | None) -> np.ndarray:
    """Token ids of a text, special tokens' strings being ordinary text, and the end token."""
    enc, text = _encoding(), text or ""
    if len(text) <= PART:
        return np.array([*enc.encode_ordinary(text), END], np.uint32)
    out, at = [], 0
    while at < len(text):
        cut = at + PART
        # Before a space that follows a letter and precedes one, the pattern always starts a new match.
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        out += enc.encode_ordinary(text[at:cut])
        at = cut
    return np.array([*out, END], np.uint32)


#: The added token of byte_bpe_50k.json, which that file finds in texts, and its id.
MARK, MARK_ID = "<|endoftext|>", 50256


def token_ids(text: str | None) -> np.ndarray:
    """Token ids of a text as byte_bpe_50k.json has them, MARK being one token, and the end token."""
    first, *others = (text or "").split(MARK)
    if not others:
        return encode(first)
    out = [encode(first)[:-1]]
    for part in others:
        out += [np.array([MARK_ID], np.uint32), encode(part)[:-1]]
    return np.concatenate([*out, np.array([END], np.uint32)])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `capacity` tokens, but the first, which has the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row per piece. Null text: the end token alone. Repeated rows: each."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            ids = token_ids(text)
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                for name, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes())), strict=True):
                    out[name].append(value)
        return out

    return text_and_id(docs, id_col, text_col).mapInArrow(lambda it: rows(it, schema, each), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each length's bin and place in it, and the number of bins. Longest first, into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0
    where, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            left, b = capacity, bins
            bins += 1
        where[i], place[i] = b, capacity - left
        if left > n:
            room[left - n].append(b)
            some |= 1 << (left - n)
    return where, place, bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most that dual feasible functions prove: no packing of these lengths has fewer bins.

    For k below half the capacity: lengths above capacity-k count as full, those under k as nothing. For a number of
    parts p: a length x counts as floor((p+1) x / capacity) / p, or x / capacity where (p+1) x divides evenly.
    """
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    at = np.arange(capacity + 1)
    best = -(-int(hist @ at) // capacity)
    for k in range(1, capacity // 2 + 1):
        total = int(hist[k : capacity - k + 1] @ at[k : capacity - k + 1]) + capacity * int(hist[capacity - k + 1 :].sum())
        best = max(best, -(-total // capacity))
    for p in range(1, 33):
        scaled = (p + 1) * at
        weight = np.where(scaled % capacity == 0, p * at, capacity * (scaled // capacity))
        best = max(best, -(-int(hist @ weight) // (capacity * p)))
    return best


def _pack_partition(capacity: int, tag: int, part_col: str, last: bool):
    """Pack each run of equal `part_col` of a task's rows; a row of a bin that isn't full leaves again if there's a gap."""

    def pack(t: pa.Table, part: int) -> pa.Table:
        lengths = column_of(t, "length")
        where, place, bins = best_fit_decreasing(lengths, capacity)
        again = np.zeros(len(lengths), bool)
        if not last and lower_bound(lengths, capacity) < bins:
            again = np.bincount(where, lengths, bins)[where] < capacity
        ids = (np.int64(tag) << 56) | (np.int64(part) << 28) | where
        for name, values in (("sequence_id", pa.array(ids, mask=again)), ("offset", pa.array(place, mask=again))):
            t = t.set_column(t.schema.get_field_index(name), name, values)
        return t

    def column_of(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            parts = column(batch, part_col).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    if held and parts[a] != now:
                        yield from pack(pa.Table.from_batches(held), now).to_batches()
                        held = []
                    now = int(parts[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from pack(pa.Table.from_batches(held), now).to_batches()

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, pieces_per_task: int = PIECES_PER_TASK, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `found` (doc_id, piece, length and others), with sequence_id and offset.

    Offsets in a sequence are gapless from 0. `found` is read some times: give a written table. No rows: none.
    """
    full = F.col("length") >= capacity
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 40))
    whole = found.filter(full).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = found.filter(~full).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    done, n = [whole], rest.count()
    for r in range(rounds):
        last = r == rounds - 1
        parts = max(1, -(-n // pieces_per_task))
        dealt = rest.withColumn("_part", (F.shiftrightunsigned(F.xxhash64(key, F.lit(r)), 1) % parts).cast("long"))
        dealt = dealt.repartition(parts, "_part").sortWithinPartitions("_part", F.desc("length"), key, "doc_id", "piece")
        packed = materialize(dealt.mapInArrow(tidy(_pack_partition(capacity, r, "_part", last)), dealt.schema).drop("_part"))
        done.append(packed.filter(F.col("sequence_id").isNotNull()))
        rest = packed.filter(F.col("sequence_id").isNull())
        n = 0 if last else rest.count()
        if not n:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts: one piece of one token. Repeated rows are packed each. Very long texts: many pieces, of which
    all but the first are sequences of their own. Extra columns are not read. An empty table: no rows.
    """
    return pack(materialize(pieces(docs, id_col, text_col, capacity)), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
