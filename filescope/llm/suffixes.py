"""Exact substring removal by suffix sorting: every 200-byte string that starts at two places is removed at both.

Comparing all suffixes of a corpus would move each byte hundreds of times. Only suffixes that can matter are sorted:

1. Every 200-byte string (a window) has an anchor, its smallest 64-byte gram by hash, the leftmost of equals. Equal
   windows have equal anchors at equal places, so a window whose anchor's gram occurs once in the corpus is unique.
   Neighbouring windows mostly share an anchor, so a document has about one anchor in 70 bytes.
2. Of the windows of one anchor the union is one string. Where that string, with its place, occurs twice, all its
   windows are repeated, and where the gram occurs once, none is. Both follow from counts by digest.
3. What is left is windows at the edges of repeated passages. Their suffixes are sorted, cut at 200 bytes: each task
   sorts its own by the deep-shallow method (multikey quicksort by eight bytes at a time to a shallow depth, then a
   blind trie for each group whose prefixes are still equal), which leaves each distinct window once; windows then meet
   across tasks by digest and count.

Digests have 128 bits: the gram's hash, and that of the string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, discard, materialize, rows, text_tag, tidy, tune, utf8

LENGTH = 200
GRAM = 64
#: Window starts that are hashed at once; longer texts are taken in such parts, which overlap by a window.
PART = 1 << 19
_BITS = 20
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Hasher:
    """Hashes of any substring of a text in constant time each, by prefix sums of a polynomial over byte values."""

    _rng = np.random.default_rng(20240229)
    _value = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _base = 0xD6E8FEB86659FD93
    _power = _inverse = np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if len(Hasher._power) < n + 1:
            size = max(1 << 16, 2 * n)
            for name, base in (("_power", self._base), ("_inverse", pow(self._base, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(Hasher, name, np.multiply.accumulate(factors))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._value[data] * self._power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._inverse[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self._inverse[:n])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _C1
    return (x ^ x >> np.uint64(29)) * _C2


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """For each run of windows with one anchor: first, last (window starts), h (the gram's hash), u (the union's)."""
    n = len(data) - length + 1
    found: dict[str, list[np.ndarray]] = {"first": [], "last": [], "h": [], "u": []}
    for s in range(0, max(n, 0), PART):
        part = np.frombuffer(data, np.uint8)[s : s + PART + length - 1]
        own, w = min(PART, n - s), length - gram + 1
        hasher = Hasher(part)
        grams = hasher.all(gram)
        low = np.uint64((1 << _BITS) - 1)
        keys = np.full(-(-len(grams) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        keys[: len(grams)] = grams & ~low | np.arange(len(grams), dtype=np.uint64)
        blocks = keys.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[:own], ahead[w - 1 : w - 1 + own]) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], own) - 1
        place = at[first]
        u = hasher.of(first, last + length) ^ (place - first).astype(np.uint64) * _C3 ^ (last - first).astype(np.uint64) * _C1
        for name, values in (("first", first + s), ("last", last + s), ("h", grams[place]), ("u", mix(u))):
            found[name].append(values)
    return {k: np.concatenate([np.empty(0, np.uint64 if k in "hu" else np.int64), *v]) for k, v in found.items()}


class BlindTrie:
    """Orders suffixes that share a long prefix: nodes keep a length and branching bytes, never the text between.

    An insertion goes down blindly to some leaf, compares with that one suffix to learn the true common prefix, and
    branches there. Suffixes are cut at `length`; equal ones share a leaf.
    """

    __slots__ = ("length", "root", "text")

    def __init__(self, text: bytes, length: int, first: int) -> None:
        self.text, self.length, self.root = text, length, [first]

    def insert(self, pos: int) -> None:
        text, length, node = self.text, self.length, self.root
        while type(node) is tuple:
            child = node[1].get(text[pos + node[0]])
            node = next(iter(node[1].values())) if child is None else child
        own, other = text[pos : pos + length], text[node[0] : node[0] + length]
        if own == other:
            node.append(pos)
            return
        differ = int.from_bytes(own, "big") ^ int.from_bytes(other, "big")
        at = length - (differ.bit_length() + 7 >> 3)
        node, parent, edge = self.root, None, -1
        while type(node) is tuple and node[0] < at:
            parent, edge = node, text[pos + node[0]]
            node = node[1][edge]
        if type(node) is tuple and node[0] == at:
            node[1][own[at]] = [pos]
            return
        new = (at, {other[at]: node, own[at]: [pos]})
        if parent is None:
            self.root = new
        else:
            parent[1][edge] = new

    def leaves(self) -> Iterator[list[int]]:
        """Groups of equal suffixes, in order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


#: Depth in bytes to which multikey quicksort goes before blind tries take over.
SHALLOW = 24


def _three_ways(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys whose groups begin at `first`: each key's new place, its part's first place, and whether it is its pivot.

    A group's pivot is the median of its first, middle and last key; smaller keys come before it, larger ones after.
    """
    size = np.diff(first, append=len(key))
    a, b, c = key[first], key[first + size // 2], key[first + size - 1]
    pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
    less, same = key < pivot, key == pivot
    start = np.repeat(first, size)
    n_less, n_same = (np.add.reduceat(x, first, dtype=np.int64) for x in (less, same))
    parts = ((less, 0), (same, n_less), (~(less | same), n_less + n_same))
    place, part = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for mine, before in parts:
        rank = np.cumsum(mine)
        rank -= np.repeat(rank[first] - mine[first], size)
        begin = start + (np.repeat(before, size) if isinstance(before, np.ndarray) else before)
        part[mine] = begin[mine]
        place[mine] = (begin + rank - 1)[mine]
    return place, part, same


def deep_shallow(text: bytes, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """`starts` in the order of text[start:start+length], and a number for each that equal strings share.

    Multikey quicksort takes eight bytes as one character and splits all groups that are open three ways at once: the
    middle part goes on eight bytes deeper. Groups that are still equal at the shallow depth go to blind tries.
    """
    raw = np.frombuffer(text + bytes(8), np.uint8).astype(np.uint64)
    word = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | raw[i : i + len(text) + 1]
    order, group, depth = np.asarray(starts, np.int64).copy(), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    deepest = min(shallow, length)
    open_ = np.arange(len(order)) if len(order) > 1 else np.empty(0, np.int64)
    while len(open_):
        pos, own, at = order[open_], group[open_], depth[open_]
        key = word[pos + at]
        over = np.maximum(at + 8 - length, 0)
        if over.any():
            key = key >> (8 * over).astype(np.uint64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        place, part, same = _three_ways(key, first)
        # Parts of a group keep its places: `open_` has them all, in order.
        target = open_[place]
        order[target], depth[target], group[target] = pos, at + 8 * same, open_[part]
        own = group[open_]
        alone = np.diff(own, prepend=-1) != 0
        alone &= np.append(alone[1:], True)
        open_ = open_[~alone & (depth[open_] < deepest)]
    if shallow < length:
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        sizes = np.diff(edges)
        for at, n in zip(edges[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            pos = order[at : at + n].tolist()
            trie = BlindTrie(text, length, pos[0])
            for p in pos[1:]:
                trie.insert(p)
            k = at
            for leaf in trie.leaves():
                order[k : k + len(leaf)] = leaf
                group[k : k + len(leaf)] = k
                k += len(leaf)
    return order, group


#: Windows of one anchor whose common part is looked at together before any suffix is sorted.
BAND = 12
#: Snippets of one gram that are sorted in one task; more are dealt by hash and meet again by digest.
SNIPPETS_PER_GROUP = 4096


def _repeated(text: bytes, at: np.ndarray, windows: np.ndarray, group: np.ndarray, place: np.ndarray, length: int, prune: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in `text` that are repeated here, and those that aren't but could be elsewhere (of salted grams).

    Snippet i has its windows at at[i], at[i]+1, ...; `place` is its gram's place from there; snippets of a `group` have
    the same gram. Where `prune` holds all snippets of the gram are here, so a band whose windows' common part occurs
    once is dropped at once.
    """
    own = np.repeat(np.arange(len(at)), windows)
    off = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = at[own] + off
    band = (place[own] - off) // BAND
    core_start = at[own] + place[own] - band * BAND
    core_end = core_start - (BAND - 1) + length
    hasher = Hasher(np.frombuffer(text, np.uint8))
    core = mix(hasher.of(np.minimum(core_start, core_end), core_end) ^ group[own].astype(np.uint64) * _C3 ^ band.astype(np.uint64) * _C1)
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (band[1:] != band[:-1])
    _, inverse, count = np.unique(core[new], return_inverse=True, return_counts=True)
    shared = (count[inverse] > 1)[np.cumsum(new) - 1] | ~prune[own]
    order, same = deep_shallow(text, start[shared], length)
    twice = np.bincount(same, minlength=len(same) + 1)[same] > 1 if len(same) else np.zeros(0, bool)
    return order[twice], order[~twice]


_RANGES = "doc_id long, tag long, first long, last long"


def _sort_snippets(length: int):
    """Of snippets that come with their gram's group (h, salt) together, emit repeated windows, or open digests."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("h", pa.int64()), ("digest", pa.int64())])

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        pieces = t.column("snippet").to_pylist()
        sizes = np.array([len(p) for p in pieces], np.int64)
        text = b"".join(pieces)
        at = np.cumsum(sizes) - sizes
        h, salts, salt = (t.column(c).to_numpy() for c in ("h", "salts", "salt"))
        _, group = np.unique(np.stack([h, salt]), axis=1, return_inverse=True)
        twice, once = _repeated(text, at, sizes - length + 1, group.ravel(), t.column("place").to_numpy(), length, salts == 1)
        first, doc, tag = (t.column(c).to_numpy() for c in ("first", "doc_id", "tag"))
        docs = t.column("doc_id").combine_chunks()
        open_ = t.column("kind").to_numpy() == 1
        for found, digests in ((np.sort(twice), False), (np.sort(once), True)):
            own = np.searchsorted(at, found, "right") - 1
            some = salts[own] > 1
            keep = some if digests else open_[own] | some
            found, own = found[keep], own[keep]
            start = first[own] + found - at[own]
            if digests or not len(found):
                digest = Hasher(np.frombuffer(text, np.uint8)).of(found, found + length) if len(found) else np.empty(0, np.uint64)
                last, hs, digest = start, pa.array(h[own]), pa.array(digest.view(np.int64))
            else:
                new = np.ones(len(found), bool)
                new[1:] = (own[1:] != own[:-1]) | (found[1:] != found[:-1] + 1)
                last = start[np.append(np.flatnonzero(new)[1:], len(found)) - 1]
                # A salted gram's repeated windows tell the other tasks that they are: one digest for each.
                tell = salts[own] > 1
                digest = Hasher(np.frombuffer(text, np.uint8)).of(found[tell], found[tell] + length)
                seen, one = np.unique(digest, return_index=True)
                if len(seen):
                    none = pa.nulls(len(seen), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.nulls(len(seen), pa.int32()), none, none, pa.array(h[own][tell][one]), pa.array(seen.view(np.int64))], schema=schema)
                own, start = own[new], start[new]
                mine = open_[own]
                own, start, last = own[mine], start[mine], last[mine]
                hs = digest = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(own)), pa.array(tag[own]), pa.array(start), pa.array(last), hs, digest], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by h and salt; groups are worked off together, some MB at a time, never split."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > 2 << 20:
                t = pa.Table.from_batches(held)
                key = np.stack([t.column("h").to_numpy(), t.column("salt").to_numpy()])
                edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
                if len(edge):
                    yield from work(t.slice(0, int(edge[-1]) + 1))
                    rest = t.slice(int(edge[-1]) + 1)
                    held, size = rest.to_batches(), rest.nbytes
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, *others) -> DataFrame:
    """Documents by id and, as ids may repeat, 64 bits of the text's hash."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_tag(text).alias("tag"), text.alias("text"), *others)


def _same(a: DataFrame, b: DataFrame):
    return [a["doc_id"].eqNullSafe(b["doc_id"]), a["tag"] == b["tag"]]


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, per_group: int = SNIPPETS_PER_GROUP) -> tuple[DataFrame, DataFrame]:
    """(sure, edges): ranges of window starts that are repeated; sure has them in one array a document."""
    tune(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)

    def find(batch: pa.RecordBatch) -> dict:
        found = [anchors(utf8(t), length, gram) for t in column(batch, "text").to_pylist()]
        n = pa.array(np.repeat(np.arange(len(found)), [len(x["h"]) for x in found]))
        out = {k: np.concatenate([x[k] for x in found]) for k in ("first", "last", "h", "u")}
        return {"doc_id": column(batch, "doc_id").take(n), "tag": column(batch, "tag").take(n), "first": out["first"], "last": out["last"], "h": out["h"].view(np.int64), "u": out["u"].view(np.int64)}

    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("h", pa.int64()), ("u", pa.int64())])
    found = materialize(keyed.mapInArrow(lambda it: rows(it, schema, find), _RANGES + ", h long, u long"))
    # Written, so that the join's sides are two exchanges: Spark can then split the tasks of a very common gram.
    common = materialize(found.groupBy("h").count().filter("count > 1").select("h"))
    shared = materialize(found.join(common, "h"))
    discard(found, common)
    counted = materialize(shared.groupBy("h", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tag", "first")).alias("rep")))
    by_gram = materialize(counted.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.max((F.col("n") == 1).cast("int")).alias("mixed")))
    unions = materialize(counted.join(by_gram, "h"))
    discard(counted, by_gram)
    # 0: repeated as a whole; 1: open; 2: repeated as a whole, and the one of its kind that open ones are compared with.
    rep = F.col("rep").eqNullSafe(F.struct("doc_id", "tag", "first")) & (F.col("mixed") == 1)
    kind = F.when(F.col("n") == 1, 1).when(rep, 2).otherwise(0)
    judged = shared.join(unions, ["h", "u"]).select("doc_id", "tag", F.struct("first", "last", kind.alias("kind"), F.when(kind > 0, F.col("h")).alias("h"), F.when(kind > 0, F.ceil(F.col("classes") / per_group).cast("int")).alias("salts")).alias("range"))
    per_doc = materialize(judged.groupBy("doc_id", "tag").agg(F.collect_list("range").alias("ranges")))
    discard(shared, unions)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("tag", pa.int64()), ("h", pa.int64()), ("salts", pa.int32()), ("kind", pa.int32()), ("first", pa.int64()), ("place", pa.int64()), ("snippet", pa.binary())]
        for batch in batches:
            out: dict[str, list] = {n: [] for n, _ in fields}
            for doc, tag, text, ranges in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "tag", "text", "open")), strict=True):
                data = utf8(text)
                for r in ranges:
                    piece = data[r["first"] : r["last"] + length]
                    grams = Hasher(np.frombuffer(piece, np.uint8)).all(gram)
                    place = int(np.flatnonzero(grams == np.uint64(r["h"] & 0xFFFFFFFFFFFFFFFF))[0])
                    for name, value in zip(out, (doc, tag, r["h"], r["salts"], r["kind"], r["first"], place, piece), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in fields], schema=pa.schema(fields))

    open_ = per_doc.select("doc_id", "tag", F.filter("ranges", lambda r: r["kind"] > 0).alias("open")).filter(F.size("open") > 0)
    joined = keyed.join(open_, _same(keyed, open_)).select(keyed["doc_id"], keyed["tag"], "text", "open")
    snippets = joined.mapInArrow(tidy(cut), "doc_id long, tag long, h long, salts int, kind int, first long, place long, snippet binary")
    snippets = snippets.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.col("salts")).cast("int"))
    local = snippets.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(tidy(_sort_snippets(length)), _RANGES + ", h long, digest long")
    local = materialize(local)
    inside = local.filter("digest is null").select("doc_id", "tag", "first", "last")
    open_digests = local.filter("digest is not null")
    again = open_digests.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("first").isNull()).alias("told")).filter("n > 1")
    across = open_digests.filter("first is not null").join(again, ["h", "digest"]).select("doc_id", "tag", "first", "last")
    return per_doc, inside.unionByName(across)


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, length: int, options: dict, *others) -> DataFrame:
    """doc_id, text, sure, edges and `others` of each row."""
    sure, edges = repeated_ranges(docs, id_col, text_col, length, **options)
    keyed = _keyed(docs, id_col, text_col, *others)
    rest = keyed.columns[3:]
    sure = sure.select("doc_id", "tag", F.filter("ranges", lambda r: r["kind"] != 1).alias("sure"))
    edges = edges.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("edges"))
    joined = keyed.join(sure, _same(keyed, sure), "left").select(keyed["doc_id"], keyed["tag"], "text", "sure", *rest)
    return joined.join(edges, _same(joined, edges), "left").select(joined["doc_id"], "text", "sure", "edges", *rest)


def _spans(batch: pa.RecordBatch, length: int) -> list[list[dict]]:
    spans = []
    for a, b in zip(column(batch, "sure").to_pylist(), column(batch, "edges").to_pylist(), strict=True):
        out: list[dict] = []
        for first, last in sorted((r["first"], r["last"]) for r in [*(a or []), *(b or [])]):
            if out and first <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], last + length)
            else:
                out.append({"start": first, "end": last + length})
        spans.append(out)
    return spans


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """doc_id, text, spans: maximal runs of bytes [start, end) of the text's UTF-8 that repeated strings cover.

    Null texts are empty; texts under `length` bytes have no spans. Rows that repeat, ids included, are documents of
    their own, so texts of `length` bytes or more vanish from both. Texts may be of any length. Extra columns are not
    read. An empty table: no rows.
    """
    joined = _with_ranges(docs, id_col, text_col, length, options)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": column(batch, "doc_id"), "text": column(batch, "text"), "spans": _spans(batch, length)}

    return joined.mapInArrow(lambda it: rows(it, schema, each), "doc_id long, text string, spans array<struct<start:long,end:long>>")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """The rows of `docs` with their text cut as removed_spans tells, and all other columns as they were.

    A character of which only some bytes go, goes. Null texts stay null.
    """
    others = [c for c in docs.columns if c != text_col]
    joined = _with_ranges(docs, id_col, text_col, length, options, F.struct(*others).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            left = [None if t is None else kept(utf8(t), s).decode("utf-8", "ignore") if s else t for t, s in zip(texts, _spans(batch, length), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(left, pa.string())], names=["row", "left"])

    out = joined.select("text", "sure", "edges", "row").mapInArrow(tidy(run), f"row {joined.schema['row'].dataType.simpleString()}, left string")
    return out.select(*(F.col("left").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def kept(data: bytes, spans: list[dict]) -> bytes:
    at, out = 0, []
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def digests(spans: DataFrame) -> DataFrame:
    """The digest row of the contract from documents with their removed spans."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def each(batch: pa.RecordBatch) -> dict:
        data, runs = [utf8(t) for t in column(batch, "text").to_pylist()], column(batch, "spans").to_pylist()
        return {
            "doc_id": column(batch, "doc_id"),
            "n_bytes": [len(d) for d in data],
            "n_removed": [sum(s["end"] - s["start"] for s in r) for r in runs],
            "n_spans": [len(r) for r in runs],
            "kept_sha256": [hashlib.sha256(kept(d, r)).hexdigest() for d, r in zip(data, runs, strict=True)],
        }

    return spans.mapInArrow(lambda it: rows(it, schema, each), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
