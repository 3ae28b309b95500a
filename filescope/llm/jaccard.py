"""Jaccard join of shingle sets: size-banded tiles, bitmap signatures that bound overlaps, then exact intersections.

Sets of 64-bit shingle hashes take the place of documents, and equal sets are one node. Two sets of the threshold differ
in a ninth of their sizes' sum at most. A set's bitmap has a bit for the parity of the hashes at each position, in two to
four times as many positions as the set has hashes; the bits by which two bitmaps differ are no more than the elements by
which the sets do, so counting bits bounds the overlap from above. What passes is intersected, as sorted arrays.

Tiles hold sets of a size band and the band above, which are all that may link. To compare a band with itself would take
the square of its sets, so that tiles are keyed besides:

1. By each of three least hashes of the set. A tile's sets gather around leaders, the tiles' leaders again, so that large
   groups of near copies take no pairs; links are verified exactly, and make first components.
2. By each hash in the set's prefix, its first three tenths in the order of hashes. Of the set whose prefix ends first, a
   fifth at most is not in the other: the rest of that prefix, over a tenth of its size, is in both prefixes. Hashes all of
   whose sets are in one component count for nothing then; a set with no more others than that tenth of the least size
   that may link with it has no link left to find, and one that has more may leave out half of it, those that most sets
   have. Keys with the same sets make one tile. In a tile, each set first proposes the nearest one of other components;
   once those links are verified, all pairs that are left between components.

Nothing is left out: the first step only spares the second work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, discard, materialize, rows, text_and_id, tidy, tune
from filescope.llm.components import components

SHINGLE = 5
#: Overlaps of LINK of the union's elements (in hundredths) link; a ninth of both sizes is what such sets differ in.
LINK = 80
#: Sets in a tile; larger ones are split.
TILE = 4096
#: Bits of the filter that spares to build arrays of sets that no candidate has.
FILTER_BITS = 1 << 24

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LEAST = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SHORT = np.uint64(0x1D8E4E27C47D124F)
#: The base of word hashes, its inverse modulo 2^64, and a random number for each byte.
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Words that are hashed at once.
WORDS_AT_ONCE = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word of a text column, flat, and each text's offsets into them (nulls: no words)."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(plain):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    edge = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    edge = edge - edge[0]
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    within = edge[(edge > 0) & (edge < len(data))]
    begins[within] = inside[within]
    ends[within - 1] = inside[within - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(begin), np.uint64)
    for a in range(0, len(begin), WORDS_AT_ONCE):
        first, last = begin[a : a + WORDS_AT_ONCE], end[a : a + WORDS_AT_ONCE]
        zero, n = int(first[0]), int(last[-1] - first[0])
        total = np.zeros(n + 1, np.uint64)
        np.add.accumulate(_BYTES[data[zero : zero + n]] * _powers(_BASE, n), out=total[1:])
        # Sums from a word's begin on, with the power of the base that stands at its begin taken out.
        own = (total[last - zero] - total[first - zero]) * _powers(_INVERSE, n)[first - zero]
        out[a : a + WORDS_AT_ONCE] = own + (last - first).astype(np.uint64) * _SHORT
    return _mixed(out), np.searchsorted(begin, edge)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's set: sorted 64-bit hashes of its distinct shingles; the whole sequence where it has fewer words."""
    w, at = word_hashes(texts)
    whole = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        whole += w[j : j + len(whole)] * _STEPS[j]
    whole = _mixed(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        else:
            short = (w[a:b] * _STEPS[: b - a]).sum(keepdims=True, dtype=np.uint64) + _SHORT * np.full(1, b - a, np.uint64)
            out.append(_mixed(short) if b > a else np.zeros(0, np.uint64))
    return out


def node_of(found: np.ndarray) -> int:
    """A set's name: 64 bits of its hashes, signed."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def prefix(found: np.ndarray) -> np.ndarray:
    """The first hashes: a fifth, which a set that links may miss, a tenth, and one more."""
    return found[: len(found) // 5 + len(found) // 10 + 1]


#: Sets that link share more keys than this: a tenth, as in prefix(), of the least size that links with n.
SPARE = "(4 * n + 4) div 5 div 10"


def bitmap(found: np.ndarray) -> bytes:
    """Parities of the hashes at 2^k positions, two to four for each hash, 64 at least."""
    width = max(64, 1 << (2 * len(found) - 1).bit_length())
    return np.packbits((np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def fold(bits: np.ndarray) -> np.ndarray:
    """Bitmaps at half their positions: the parity of both halves together."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, node, bits, least, keys: each document's set with its bitmap, three least hashes and its prefix."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bits", pa.binary()), ("least", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def each(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(column(batch, "text"))
        whole = lambda f: [f(s) if len(s) else None for s in sets]
        return {
            "doc_id": column(batch, "doc_id"),
            "n": [len(s) for s in sets],
            "node": whole(node_of),
            "bits": whole(bitmap),
            "least": whole(lambda s: (s[:, None] * _LEAST).min(0).view(np.int64)),
            "keys": whole(lambda s: prefix(s).view(np.int64)),
        }

    return docs.mapInArrow(lambda it: rows(it, schema, each), "doc_id long, n long, node long, bits binary, least array<long>, keys array<long>")


class Tile:
    """Sets of a tile by size, their bitmaps in a matrix for each width."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, bits: list[bytes]) -> None:
        order = np.lexsort((nodes, sizes))
        self.node, self.n = nodes[order], sizes[order]
        width = np.array([len(b) for b in bits])[order]
        self.width, self.rows = width, {}
        edge = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), len(width)]
        for a, b in zip(edge, edge[1:], strict=False):  # widths grow with sizes
            joined = b"".join(bits[i] for i in order[a:b].tolist())
            self.rows[int(width[a])] = (a, b, np.frombuffer(joined, np.uint64).reshape(b - a, -1))
        self.order = order

    def near(self, i: int, free: np.ndarray, smaller: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sets behind i in size order (before it too, if `smaller`), among `free`, that may link; and bits that differ."""
        size, own_width = int(self.n[i]), int(self.width[i])
        first = int(np.searchsorted(self.n, (4 * size + 4) // 5)) if smaller else i + 1
        last = int(np.searchsorted(self.n, 5 * size // 4, side="right"))
        a, _, own = self.rows[own_width]
        mine, where, bits = own[i - a], [], []
        for width in (own_width // 2, own_width, 2 * own_width):
            if width not in self.rows:
                continue
            a, b, matrix = self.rows[width]
            some = np.arange(max(a, first), min(b, last))
            some = some[free[some]]
            if len(some):
                theirs = matrix[some - a]
                pair = (fold(theirs), mine) if width > own_width else (theirs, fold(mine)) if width < own_width else (theirs, mine)
                where.append(some)
                bits.append(np.bitwise_count(pair[0] ^ pair[1]).sum(1, dtype=np.int64))
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, differ = np.concatenate(where), np.concatenate(bits)
        # |A|+|B| - 2 * overlap >= bits that differ, and links have 9 * overlap >= 4 * (|A|+|B|).
        fits = 9 * differ <= self.n[at] + size
        return at[fits], differ[fits]


def gathered(tile: Tile) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(a, b) candidates around leaders, each set with one leader at most; and the leaders, as they came."""
    out, lead = [], np.ones(len(tile.node), bool)
    free = np.ones(len(tile.node), bool)
    for i in range(len(tile.node)):
        if free[i]:
            at, _ = tile.near(i, free)
            free[at] = lead[at] = False
            out += [(x, int(tile.node[i])) for x in tile.node[at].tolist()]
    return out, tile.order[lead]


def fit(a: bytes, b: bytes, total: int) -> bool:
    """Whether two bitmaps allow their sets, of `total` hashes together, to link."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        half = len(b) // 2
        x = int.from_bytes(b[:half]) ^ int.from_bytes(b[half:]) ^ int.from_bytes(a)
    else:
        x = int.from_bytes(a) ^ int.from_bytes(b)
    return 9 * x.bit_count() <= total


def between(tile: Tile, comps: np.ndarray, guests: np.ndarray, nearest: bool) -> list[tuple[int, int]]:
    """Candidates of different components, not both guests; with `nearest`, of each set only the one that differs least.

    The largest component's sets are only met by the others.
    """
    comp, guest = comps[tile.order], guests[tile.order]
    value, count = np.unique(comp, return_counts=True)
    most = comp == value[count.argmax()]
    free, out = np.ones(len(comp), bool), []
    for i in np.flatnonzero(~most).tolist():
        free[i] = False  # met all that it may meet
        other = free & (comp != comp[i])
        at, differ = tile.near(i, other & ~guest if guest[i] else other, smaller=True)
        if nearest and len(at) > 1:
            at = at[differ.argmin() :][:1]
        out += [(int(tile.node[i]), x) for x in tile.node[at].tolist()]
    return out


def _tiles(members: DataFrame, keys: list[str], size: int, pairs: bool, shift=0) -> DataFrame:
    """Members (node, n, bits, comp, keys) gathered by key in lists of about `size` at most, by size band; `split` tells
    whether a tile has several lists.

    `shift` moves the bands' edges. With `pairs`, each member is in the tile of its band and in that of the band below, and of larger tiles each pair of
    chunks is a list, so that any two members whose sizes fit are together in one. Else chunks are lists of their own.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.25)) + shift).cast("int")
    if pairs:
        banded = members.withColumn("x", F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band - 1).alias("band"), F.lit(True).alias("guest")))))
        banded = banded.select("*", "x.band", "x.guest").drop("x")
    else:
        banded = members.withColumns({"band": band, "guest": F.lit(False)})
    # Written, so that the join's sides are two exchanges: Spark can then split the tasks of a key with very many sets.
    count = materialize(banded.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("in_tile"), F.bool_and("guest").alias("all")).filter("in_tile > 1 and not all").drop("all"))
    met = banded.join(count, [*keys, "band"])
    chunks = F.ceil(F.col("in_tile") / size)
    met = met.withColumn("c", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    if pairs:
        met = met.withColumn("d", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
        met = met.withColumns({"c": F.least("c", "d"), "d": F.greatest("c", "d")})
    else:
        met = met.withColumn("d", F.lit(0))
    return met.groupBy(*keys, "band", "c", "d").agg(F.first(chunks > 1).alias("split"), F.collect_list(F.struct("node", "n", "comp", "guest", "bits")).alias("sets")).select(*keys, "split", "sets")


def _opened(batch: pa.RecordBatch):
    """(row, place, nodes, sizes, components, guests, bitmaps) of each list of a batch with two sets at least."""
    sets = column(batch, "sets")
    flat, at = sets.flatten(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
    node, n, comp = (flat.field(c).to_numpy() for c in ("node", "n", "comp"))
    guest, bits = flat.field("guest").to_numpy(zero_copy_only=False), flat.field("bits")
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a > 1:
            yield row, a, node[a:b], n[a:b], comp[a:b], guest[a:b], bits.slice(a, b - a).to_pylist()


def _pairs(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])


def around_leaders(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b) candidates of sets that share a least hash; of tiles of several lists, the lists' leaders meet again.

    Bands have other edges for each of the three hashes, so that sets beside an edge meet by another hash.
    """
    members = sets.select("node", "n", "bits", F.col("node").alias("comp"), F.posexplode("least").alias("which", "key"))
    shared = materialize(members.groupBy("which", "key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("which", "key"))
    members = materialize(members.join(shared, ["which", "key"]))
    ddl = "a long, b long, which int, key long, n long, bits binary"
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("which", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, which, key, split = column(batch, "sets").flatten(), *(column(batch, c).to_pylist() for c in ("which", "key", "split"))
            for row, a, node, n, _, _, bits in _opened(batch):
                found, leaders = gathered(Tile(node, n, bits))
                if found:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*found, strict=True)), *(pa.nulls(len(found), f.type) for f in list(schema)[2:])], schema=schema)
                if split[row]:
                    own, k = flat.take(pa.array(leaders + a)), len(leaders)
                    yield pa.RecordBatch.from_arrays([own.field("node"), pa.nulls(k, pa.int64()), pa.array([which[row]] * k, pa.int32()), pa.array([key[row]] * k, pa.int64()), own.field("n"), own.field("bits")], schema=schema)

    every, before = None, None
    while True:
        lists = _tiles(members, ["which", "key"], tile, False, F.col("which") / 3)
        found = materialize(lists.mapInArrow(tidy(gather), ddl))
        links = found.filter("b is not null").select("a", "b")
        every = links if every is None else every.unionByName(links)
        members = found.filter("b is null").select(F.col("a").alias("node"), "n", "bits", F.col("a").alias("comp"), "which", "key")
        left = members.count()
        # Leaders that do not thin out are sets that have nothing in common but the hash.
        if not left or (before is not None and left > 0.9 * before):
            return every.distinct()
        before = left


def across(members: DataFrame, nearest: bool, tile: int = TILE) -> DataFrame:
    """(a, b) candidates of different components among members (key, node, n, bits, comp) with a key in common."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, node, n, comp, guest, bits in _opened(batch):
                if len(node) > 2:
                    out += between(Tile(node, n, bits), comp, guest, nearest)
                elif comp[0] != comp[1] and not guest.all() and 4 * n.max() <= 5 * n.min() and fit(*bits, int(n.sum())):
                    out.append((int(node[0]), int(node[1])))
            yield from _pairs(out)

    return _tiles(members, ["key"], tile, True).mapInArrow(tidy(meet), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _filter(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of `bits` bits, a power of two, with one for each node (node): at most bits/64 rows reach the driver."""
    spot = F.col("node").bitwiseAND(F.lit(bits - 1))
    on = F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))"))
    found = nodes.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(on.alias("on")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("on").to_numpy()
    return out


def arrays(docs: DataFrame, nodes: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame | None:
    """node, hashes: the whole sets of `nodes` (node), built again from the texts; None if there are no nodes.

    A filter of bounded size spares to hand on most others; what passes it by chance meets no candidate.
    """
    seen = _filter(nodes, filter_bits)
    if not seen.any():
        return None
    sent = docs.sparkSession.sparkContext.broadcast(seen)
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def build(batch: pa.RecordBatch) -> dict:
        sets = [(node_of(s), s) for s in shingle_sets(column(batch, "text")) if len(s)]
        wanted = [(x, s) for x, s in sets if int(sent.value[(x & (filter_bits - 1)) >> 6]) >> (x & 63) & 1]
        return {"node": [x for x, _ in wanted], "hashes": [s.tobytes() for _, s in wanted]}

    return materialize(docs.mapInArrow(lambda it: rows(it, schema, build), "node long, hashes binary").dropDuplicates(["node"]))


def verified(candidates: DataFrame, sets: DataFrame | None) -> DataFrame:
    """Those of the candidates (a, b) whose sets, as `sets` (node, hashes) has them, meet the threshold."""
    if sets is None:
        return candidates.limit(0)
    one = candidates.join(sets.withColumnsRenamed({"node": "a", "hashes": "ha"}), "a")
    both = one.join(sets.withColumnsRenamed({"node": "b", "hashes": "hb"}), "b").select("a", "b", "ha", "hb")
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batch: pa.RecordBatch) -> dict:
        sure = []
        for x, y in zip(column(batch, "ha").to_pylist(), column(batch, "hb").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            sure.append(100 * both >= LINK * (len(p) + len(q) - both))
        return {c: column(batch, c).filter(pa.array(sure, pa.bool_())) for c in ("a", "b")}

    return both.mapInArrow(lambda it: rows(it, link_schema, meet), "a long, b long")


def open_members(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, n, bits, comp of the sets that may link with one of another component, by the keys they must meet under.

    A key is open if its sets are of several components. A set without more than SPARE open keys has no link left; one
    that has may leave out half of SPARE of them, as any two sets that link still share one then.
    """
    rooted = materialize(sets.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root", "least"))
    discard(sets)
    keyed = rooted.select("node", "n", "comp", F.explode("keys").alias("key"))
    count = materialize(keyed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("k")).filter("least < most").select("key", "k"))
    own = keyed.join(count, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("k", "key"))).alias("keys"))
    kept = own.withColumn("spare", F.expr(SPARE).cast("int")).filter("size(keys) > spare").select("node", F.explode(F.expr("slice(keys, 1, size(keys) - spare div 2)")).alias("x"))
    kept = materialize(kept.select("node", "x.key"))
    # Keys that have the same sets, by two hashes of them and their number, are one: tiles of both would tell the same.
    same = kept.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("k > 1")
    first = materialize(same.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key"))
    return materialize(kept.join(first, "key").join(rooted.select("node", "n", "bits", "comp"), "node"))


#: Rounds in which sets propose their nearest ones, before all pairs between components are proposed.
ROUNDS = 2


def _of_components(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) between nodes as links between their components, whose names are those of `roots` (node, root)."""
    own = lambda end: roots.withColumnsRenamed({"node": end, "root": f"root_{end}"})
    both = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return both.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))


def linked(docs: DataFrame, sets: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, root) of the distinct sets that link with another: root is the name of the component that links make.

    `sets` is discarded.
    """
    spark = docs.sparkSession
    near = materialize(around_leaders(sets, tile))
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    roots = components(materialize(verified(near, arrays(docs, ends(near)))))
    members = open_members(sets, roots).withColumn("first", F.col("comp"))
    whole = arrays(docs, members.select("node"))
    # What the first step has linked is one end of links from here on, so that only these few are joined anew.
    more, joined = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "_of long, _to long")
    for nearest in (True,) * ROUNDS + (False,):
        found = materialize(verified(materialize(across(members, nearest, tile)), whole))
        if found.isEmpty():
            continue
        more = materialize(more.unionByName(found))
        joined = components(materialize(_of_components(more, roots))).withColumnsRenamed({"node": "_of", "root": "_to"})
        if nearest:
            members = materialize(members.join(joined, members["first"] == joined["_of"], "left").withColumn("comp", F.coalesce("_to", "first")).drop("_of", "_to"))
    both = roots.select("node", "root").unionByName(ends(more).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    # A component's own name may lead to another one's, too.
    both = both.unionByName(joined.select(F.col("_of").alias("node"), F.col("_of").alias("root")).join(both.select("node"), "node", "left_anti"))
    return both.join(joined, both["root"] == joined["_of"], "left").select("node", F.coalesce("_to", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links of LINK hundredths reach, itself included.

    A text's set are its distinct shingles of SHINGLE words; with fewer words, all of them as one. Null, empty and blank
    texts have no set and link with nothing, not even each other: their component_id is their doc_id. Repeated rows: a row
    each, in one component. Null ids keep their rows, and are a component's id only if it has no other. Shingles and sets
    are told apart by 64 bits. Extra columns are not read. An empty table: no rows.
    """
    tune(docs.sparkSession)
    own = text_and_id(docs, id_col, text_col)
    every = materialize(signed(own))
    found = materialize(every.select("doc_id", "n", "node"))
    sets = materialize(every.filter("n > 0").drop("doc_id").dropDuplicates(["node"]))
    discard(every)
    roots = linked(own.select("text"), sets, tile)
    least = materialize(found.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")))
    rooted = least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(ids, "root").select("node", "component_id"))
    out = found.join(classes, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), lists as (
  select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i : i + {SHINGLE} - 1], ' '))) end as s from words
), sets as (
  select doc_id, len(s) as n, list_sort(s) as s from lists
), nodes as (
  select min(doc_id) as node, n, s from sets where n > 0 group by n, s
), flat as (
  select node, n, unnest(s) as shingle from nodes
), met as (
  select a.node as a, b.node as b, any_value(a.n) + any_value(b.n) as total, count(*) as shared
  from flat a join flat b on a.shingle = b.shingle and a.node < b.node and 4 * b.n <= 5 * a.n and 4 * a.n <= 5 * b.n group by 1, 2
), edges as (
  select a, b from met where 100 * shared >= {LINK} * (total - shared)
), both_ways as (
  select a, b from edges union all select b, a from edges
), reach as (
  select node as a, node as b from nodes union select r.a, e.b from reach r join both_ways e on r.b = e.a
), least as (
  select a as node, min(b) as component_id from reach group by 1
)
select d.doc_id, d.n as n_shingles, case when d.n = 0 then d.doc_id else l.component_id end as component_id
from sets d left join nodes c on d.n > 0 and c.n = d.n and c.s = d.s left join least l on l.node = c.node
"""
