"""Archives inside of archives: every member a blob of its own, detected and judged by the same rules.

The containers of one depth are a frontier, a table in the shared folder. A round opens them in Arrow batches, each in a
task's memory, and gives their members through detection and rules; the containers among these are the next frontier.
There are as many rounds as the deepest archive has levels, whatever their number, and rounds end at a depth.

A budget of bytes goes along with each container, so that tasks need not ask each other: members in the order of the
directory are read while their declared sizes fit, and what is left is shared equally by the containers among them. A
root thus never expands to more than its budget, and which members are read depends on it alone. Archives that are
stored in each other expand to the root's own bytes once a level without any compression, so that a budget that is the
same for all roots would stop large ones: it may grow with the root's bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.functions import archive, names
from filescope.functions.registry import RISK_ORDER
from filescope.operators import analyze, rules
from filescope.sources import shared


class Limits(NamedTuple):
    depth: int = 5  # archives at this depth are not opened any more; a root has depth 0
    total: int = 200_000_000  # bytes that a root may expand to
    entry: int = archive.ENTRY_LIMIT  # bytes of a member
    times: int = 0  # a root may also expand to so often its own bytes, if these are more than total


#: Types that are opened. Office files and books are ZIP files too, but their parts are no files of their own.
OPENED = ("zip", "jar", "apk")
#: What became of a member; all but the first leave it without content.
READ, LOCKED, LARGE, OVER, BROKEN = "read", "encrypted", "too large", "over budget", "broken"
#: Members that were left out at a limit.
LEFT_OUT = (LARGE, OVER)
#: Bytes of members that are handed on at once.
BATCH = 8 << 20

_MEMBER = "root_id long, place string, inside string, path string, depth int, state string, left long, file_name string, content binary, size long"
_SCHEMA = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _MEMBER.split(", "))])


def members(data: bytes, left: int, limits: Limits) -> Iterator[tuple[archive.Entry, str, bytes | None, int]]:
    """(entry, state, content, budget) of an archive's members, folders left out; archives among them come last."""
    try:
        entries = archive.directory(data)
    except (archive.ZipError, ValueError, IndexError):
        return  # the archive's own findings say so
    nested: list[tuple[archive.Entry, bytes]] = []
    for e in entries:
        if e.name.endswith("/"):
            continue
        if e.encrypted:
            yield e, LOCKED, None, 0
        elif e.uncompressed_size > limits.entry:
            yield e, LARGE, None, 0
        elif e.uncompressed_size > left:
            yield e, OVER, None, 0
        else:
            # A byte more than declared is asked for, so that a member which is longer than it says is found out.
            own = archive.read(data, e, e.uncompressed_size + 1)
            if own is None or len(own) != e.uncompressed_size or zlib.crc32(own) != e.crc32:
                yield e, BROKEN, None, 0
                continue
            left -= len(own)
            if own[:2] == b"PK":
                nested.append((e, own))
            else:
                yield e, READ, own, 0
    for e, own in nested:
        yield e, READ, own, left // len(nested)


def _expand(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        for some in batches:
            for row in range(some.num_rows):  # one container's bytes at a time become Python's
                root, place, path, depth, left, data = (some.column(c)[row].as_py() for c in ("root_id", "place", "path", "depth", "left", "content"))
                for e, state, own, share in members(data, left, limits):
                    held.append((root, f"{place}/{e.ordinal}", place, f"{path}!/{e.name}", depth + 1, state, share, e.name, own, e.uncompressed_size))
                    size += len(own or b"") + 200
                    if size > BATCH:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    return run


def _judged(found: DataFrame, last: bool) -> DataFrame:
    """Members with their type and findings; content and budget only of archives, which are opened unless `last`."""
    own = analyze.assess(found.withColumn("file_name", names.sanitize(F.col("file_name"))))
    archives = (F.col("state") == READ) & F.col("detection.type").isin(*OPENED) & F.col("zip.error").isNull()
    kept = ("root_id", "place", "inside", "path", "depth", "state", "size", "sha256", "detection", "extension_match", "findings", "risk_score", "risk_level", "scan_complete")
    return own.select(*kept, "left", F.when(archives, F.col("content")).alias("content"), (archives & F.lit(last)).alias("closed"))


def tree(blobs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each blob (depth 0) and each member of archives at any depth, with its type, findings and level.

    place is unique in a root: the ordinals of the archives' entries on the way, and `inside` the place of the archive
    that holds the member (null for roots). A member that is encrypted, broken, larger than limits.entry or beyond the
    root's budget has no content, so that its type is unknown and its level UNKNOWN. An archive that had members left out
    at a limit, or lies at limits.depth, has a finding, and level UNKNOWN. Repeated ids: trees that share their root_id.
    Null contents: roots of state "too large" without members. Jobs run when this is called: one a level.
    """
    roots = blobs.select(
        F.col("blob_id").alias("root_id"), F.lit("").alias("place"), F.lit(None).cast("string").alias("inside"), F.col("file_name").alias("path"), F.lit(0).alias("depth"),
        F.when(F.col("content").isNull(), LARGE).otherwise(READ).alias("state"), F.greatest(F.lit(limits.total).cast("long"), F.coalesce("size", F.lit(0).cast("long")) * limits.times).alias("left"), "file_name", "content", F.coalesce("size", F.lit(0).cast("long")).alias("size"),
    )
    level, every = roots, None
    for depth in range(limits.depth + 1):
        found = shared.written(_judged(level, depth == limits.depth))
        plain = found.drop("content", "left")
        every = plain if every is None else every.unionByName(plain)
        opened = found.filter("content is not null and not closed")
        if opened.isEmpty():
            break
        level = opened.select("root_id", "place", "path", "depth", "left", "content").mapInArrow(_expand(limits), _MEMBER)
    return _with_stops(every)


def _with_stops(every: DataFrame) -> DataFrame:
    """All members, with the finding of archives whose members were left out, which changes their score and level."""
    stops = every.filter(F.col("state").isin(*LEFT_OUT) & F.col("inside").isNotNull()).groupBy("root_id", "inside").agg(F.count(F.lit(1)).alias("_out"), F.min_by("path", "place").alias("_first"))
    stops = stops.withColumnsRenamed({"root_id": "_root", "inside": "_place"})
    out = every.join(stops, (every["root_id"] == stops["_root"]) & (every["place"] == stops["_place"]), "left").drop("_root", "_place")
    stopped = F.col("closed") | F.col("_out").isNotNull()
    told = F.when(F.col("closed"), F.lit("not opened")).otherwise(F.concat(F.col("_out").cast("string"), F.lit(" members, first "), F.col("_first")))
    some = F.filter("findings", lambda f: f["points"] > 0)
    with_stop = F.concat(some, F.array(rules.noted("Z9", told)))
    out = out.withColumn("findings", F.when(stopped, with_stop).otherwise(F.col("findings")))
    score = F.least(F.lit(100), F.aggregate("findings", F.lit(0), lambda a, f: a + f["points"]))
    out = out.withColumns({"risk_score": score, "scan_complete": F.col("scan_complete") & ~stopped, "stopped": stopped})
    return out.withColumn("risk_level", rules.level(F.col("risk_score"), F.col("scan_complete"))).drop("_out", "_first", "closed")


def summary(found: DataFrame) -> DataFrame:
    """A row per root of a tree: members, bytes read, depth, members left out, and the first of the worst known levels."""
    rank = F.array_position(F.array(*map(F.lit, RISK_ORDER[:-1])), F.col("risk_level"))  # 0: UNKNOWN
    inner = F.col("depth") > 0
    worst = F.max_by(F.struct("path", "risk_level"), F.struct(rank, -F.col("depth"), F.col("place")))
    out = found.groupBy("root_id").agg(
        F.count_if(inner).alias("members"), F.coalesce(F.sum(F.when(inner & (F.col("state") == READ), F.col("size"))), F.lit(0)).alias("expanded"), F.max("depth").alias("deepest"),
        F.count_if(inner & (F.col("state") != READ)).alias("unread"), F.bool_or("stopped").alias("stopped"), F.bool_and("scan_complete").alias("complete"), worst.alias("_worst"),
    )
    return out.select("root_id", "members", "expanded", "deepest", "unread", "stopped", "complete", F.col("_worst.path").alias("worst_path"), F.col("_worst.risk_level").alias("worst_level"))
