"""Media columns: baseline JPEG, whose DC coefficients carry bytes and give luminance thumbnails.

`encode_columns` stores a payload as a sequence of grey baseline JPEG frames. A sample of the payload is the DC
coefficient of an 8x8 block (quantiser 8, no AC), so a frame's DC-only thumbnail is the payload, 64 samples a row.
Each row is a restart interval: rows decode independently of each other. `thumbnail_columns` parses the markers of any
baseline JPEG (grey or colour, any sampling, with or without restarts), Huffman-decodes its scan in numpy, and makes
the luminance thumbnail from the DC coefficients alone; the AC symbols are decoded only to be skipped.

The Huffman tables in the frames give every difference of category s a code of 15-s bits, s bits of magnitude and one
bit for the end of block: sixteen bits a block, whose last is zero, so that no 0xFF needs stuffing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filescope.llm.common import column, rows, text_and_id, tidy, tune, utf8

WIDTH = 64
#: A JPEG's height has 16 bits.
ROWS = 65535 // 8
_CATEGORY = np.concatenate([[0], np.floor(np.log2(np.arange(1, 2048))).astype(np.int64) + 1])


def _huffman_codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, length, code) of a DHT segment, canonical."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], length, code))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_DC_COUNTS = bytes([0] * 6 + [1] * 9 + [0])
_DC_SYMBOLS = bytes(range(8, -1, -1))
_AC_COUNTS = bytes([1] + [0] * 15)
_PREFIX = np.zeros(9, np.int64)
for _s, _l, _c in _huffman_codes(_DC_COUNTS, _DC_SYMBOLS):
    _PREFIX[_s] = _c << (_s + 1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame(samples: np.ndarray) -> bytes:
    """One frame from samples of shape (rows, 64)."""
    level = samples.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = _CATEGORY[np.abs(diff)]
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    words = (_PREFIX[size] | bits << 1).astype(">u2")
    n = len(samples)
    scan = np.empty((n, 2 * WIDTH + 2), np.uint8)
    scan[:, : 2 * WIDTH] = words.view(np.uint8).reshape(n, 2 * WIDTH)
    scan[:, -2] = 0xFF
    scan[:, -1] = 0xD0 + np.arange(n) % 8
    head = (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, bytes([0]) + bytes([8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * n, 8 * WIDTH, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\0" + _DC_COUNTS + _DC_SYMBOLS)
        + _segment(0xC4, b"\x10" + _AC_COUNTS + b"\0")
        + _segment(0xDD, struct.pack(">H", WIDTH))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )
    return head + scan.tobytes()[:-2] + b"\xff\xd9"


def encode(payload: bytes) -> bytes:
    """The frames of a payload, whose length is a positive multiple of 64, one after the other."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(_frame(samples[i : i + ROWS]) for i in range(0, len(samples), ROWS))


class BadImage(ValueError):
    """The bytes are not a baseline JPEG that can be decoded."""


class _Scan:
    """What the markers of one frame say."""

    __slots__ = ("ac", "components", "data", "dc", "height", "mcus", "mcus_x", "quant", "restart", "starts", "width")


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0: no code."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, length, code in _huffman_codes(counts, symbols):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


_LOOKUPS: dict[bytes, np.ndarray] = {}


def parse(data: bytes, at: int = 0) -> tuple[_Scan, int]:
    """Markers of the frame at `at`, up to its scan's end; also where the frame ends. Bad or unsupported: BadImage."""
    if data[at : at + 2] != b"\xff\xd8":
        raise BadImage("no SOI")
    x, tables, quants, frame = _Scan(), {}, {}, None
    x.restart = 0
    at += 2
    while True:
        while at < len(data) and data[at] == 0xFF and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise BadImage("marker expected")
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                quants[which] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                key = body[1 : 17 + n]
                if key not in _LOOKUPS:
                    if len(_LOOKUPS) >= 64:
                        _LOOKUPS.clear()
                    _LOOKUPS[key] = _lookup(body[1:17], body[17 : 17 + n])
                tables[body[0]] = _LOOKUPS[key]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, x.height, x.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not x.height or not x.width:
                raise BadImage("depth or size")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise BadImage("not baseline")
        elif marker == 0xDD:
            x.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
        elif marker == 0xD9:
            raise BadImage("no scan")
    if frame is None or body[0] != len(frame):
        raise BadImage("scan without frame, or not interleaved")
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    try:
        single = len(frame) == 1
        x.components = [(1, 1) if single else (h, v) for _, h, v, _ in frame]
        x.quant = quants[frame[0][3]]
        x.dc = [tables[chosen[c] >> 4] for c, *_ in frame]
        x.ac = [tables[0x10 | chosen[c] & 15] for c, *_ in frame]
    except KeyError as e:
        raise BadImage("missing table") from e
    wide, high = 8 * max(h for h, _ in x.components), 8 * max(v for _, v in x.components)
    x.mcus_x = -(-x.width // wide)
    x.mcus = x.mcus_x * -(-x.height // high)
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    end = int(ends[0]) if len(ends) else len(raw)
    ff, after = ff[ff < end], after[ff < end]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    x.starts = np.concatenate([[0], np.cumsum(keep)[marks]]).astype(np.int64)
    x.data = raw[:end][keep]
    return x, at + end + (2 if len(ends) and raw[end + 1] == 0xD9 else 0)


def _same_tables(a: _Scan, b: _Scan) -> bool:
    return a.components == b.components and all(s is t for s, t in zip(a.dc + a.ac, b.dc + b.ac, strict=True))


def decode_scans(scans: list[_Scan]) -> list[np.ndarray]:
    """Luminance DC coefficients (not dequantised) of scans with the same tables, each (rows, columns) of blocks.

    All restart intervals of all scans advance together, one block at a time; a truncated interval repeats its last DC.
    """
    first = scans[0]
    blocks = [c for c, (h, v) in enumerate(first.components) for _ in range(h * v)]
    intervals = [(min(x.restart or x.mcus, x.mcus - i * (x.restart or x.mcus))) for x in scans for i in range(-(-x.mcus // (x.restart or x.mcus)))]
    count = np.array(intervals, np.int64)
    data = np.concatenate([*(x.data for x in scans), np.zeros(8, np.uint8)])
    base = np.cumsum([0] + [len(x.data) for x in scans])
    pos = np.zeros(len(count), np.int64)
    end, k = np.zeros(len(count), np.int64), 0
    for x, b in zip(scans, base, strict=False):
        n = -(-x.mcus // (x.restart or x.mcus))
        s = x.starts[:n]
        pos[k : k + len(s)] = (b + s) * 8
        end[k : k + len(s)] = (b + np.append(s[1:], len(x.data) if len(x.starts) <= n else x.starts[n])) * 8
        k += n
    word = np.zeros(len(data) - 4, np.int64)
    for i in range(5):
        word = word << 8 | data[i : len(data) - 4 + i]
    top = len(word) - 1

    def peek(at: np.ndarray, n) -> np.ndarray:
        return word[np.minimum(at >> 3, top)] >> (40 - n - (at & 7)) & ((1 << n) - 1)

    order = np.argsort(-count, kind="stable")
    falling = -count[order]
    pred = np.zeros((len(first.components), len(count)), np.int64)
    lum = first.components[0][0] * first.components[0][1]
    out = np.zeros((len(count), int(count.max(initial=0)), lum), np.int32)
    for step in range(out.shape[1]):
        live = order[: np.searchsorted(falling, -step, "left")]
        seen = 0
        for c in blocks:
            at = pos[live]
            hit = first.dc[c][peek(at, 16)]
            at = at + (hit >> 8)
            size = (hit & 255).astype(np.int64)
            bits = peek(at, np.minimum(size, 24))
            diff = np.where((size > 0) & (bits < 1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)
            at = at + size
            good = (hit != 0) & (at <= end[live])
            pred[c, live] += np.where(good, diff, 0)
            if c == 0:
                out[live, step, seen] = pred[0, live]
                seen += 1
            ac, k, who = first.ac[c], np.ones(len(live), np.int64), np.flatnonzero(good)
            while len(who):
                hit = ac[peek(at[who], 16)]
                run, size = hit >> 4 & 15, hit & 15
                at[who] += (hit >> 8) + size
                k[who] += np.where(size == 0, np.where(run == 15, 16, 64), run + 1)
                who = who[(k[who] < 64) & (at[who] <= end[live][who]) & (hit != 0)]
            pos[live] = np.where(good, at, end[live])
    result, k = [], 0
    h, v = first.components[0]
    for x in scans:
        n = -(-x.mcus // (x.restart or x.mcus))
        flat = np.concatenate([out[k + i, : count[k + i]] for i in range(n)]) if n > 1 and x.mcus % (x.restart or x.mcus) else out[k : k + n, : count[k]].reshape(-1, lum)
        grid = flat.reshape(-1, x.mcus_x, v, h).transpose(0, 2, 1, 3).reshape(-1, x.mcus_x * h)
        result.append(grid)
        k += n
    return result


def thumbnails(media: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """For each value its frames' (width, height, thumbnail of uint8); None where it is null or no baseline JPEG."""
    found: list[list[tuple[int, _Scan]] | None] = []
    kinds: list[list[_Scan]] = []
    for data in media:
        try:
            at, frames = 0, []
            while data is not None and at < len(data):
                scan, at = parse(data, at)
                frames.append(scan)
            found.append(frames or None)
        except (BadImage, IndexError, struct.error):
            found.append(None)
            continue
        for scan in frames:
            for kind in kinds:
                if _same_tables(kind[0], scan):
                    kind.append(scan)
                    break
            else:
                kinds.append([scan])
    grids = {id(s): g for kind in kinds for s, g in zip(kind, decode_scans(kind), strict=True)}

    def thumb(s: _Scan) -> np.ndarray:
        level = grids[id(s)] * s.quant
        return np.clip((level + 4) // 8 + 128, 0, 255).astype(np.uint8)

    return [None if x is None else [(s.width, s.height, thumb(s)) for s in x] for x in found]


def thumbnail_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each of 8x8 cells of a thumbnail is brighter than the mean of the cells."""
    r, c = (np.arange(9) * n // 8 for n in thumb.shape)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    r2, c2 = np.maximum(r[1:], r[:-1] + 1), np.maximum(c[1:], c[:-1] + 1)
    a, b = np.ix_(r[:-1], c[:-1]), np.ix_(r2, c2)
    cells = (total[b] - total[np.ix_(r[:-1], c2)] - total[np.ix_(r2, c[:-1])] + total[a]) / np.outer(r2 - r[:-1], c2 - c[:-1])
    return int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), "big")


def hash_of_frames(thumbs: list[np.ndarray]) -> str:
    """16 digits: the thumbnail hash of one frame; of several, the start of the SHA-256 of all frames' shapes and samples."""
    if len(thumbs) == 1:
        return f"{thumbnail_hash(thumbs[0]):016x}"
    whole = hashlib.sha256()
    for t in thumbs:
        whole.update(repr(t.shape).encode())
        whole.update(np.ascontiguousarray(t))
    return whole.hexdigest()[:16]


def pad(data: bytes) -> bytes:
    """`data` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as JPEG frames.

    Null and empty texts: 64 bytes 0. Null ids stay null. Repeated rows: a row each. Texts of any length: a frame holds
    8,191 rows, and a long text has several. Extra columns are not read. An empty table: no rows.
    """
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def each(batch: pa.RecordBatch) -> dict:
        data = [utf8(t) for t in column(batch, "text").to_pylist()]
        return {"doc_id": column(batch, "doc_id"), "n_bytes": [len(d) for d in data], "media": [encode(pad(d)) for d in data]}

    return text_and_id(docs, id_col, text_col).mapInArrow(lambda it: rows(it, schema, each), "doc_id long, n_bytes long, media binary")


def thumbnail_columns(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of `media`, with width, height and n_frames of the JPEG, its thumbnail's bytes and thumbnail hash.

    Several frames one after the other: the first frame's width, the sum of heights, the thumbnails joined, and one hash of
    all of them (see hash_of_frames). Null or broken media: nulls. The names width, height, n_frames, thumbnail, thumbnail_hash are overwritten.
    """
    tune(media.sparkSession)
    new = [("width", pa.int64()), ("height", pa.int64()), ("n_frames", pa.int32()), ("thumbnail", pa.binary()), ("thumbnail_hash", pa.string())]
    kept = media.drop(*(n for n, _ in new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = column(batch, media_col).to_pylist()
            done: list = []
            for i in range(0, len(values), 200):
                done += thumbnails(values[i : i + 200])
            cols: dict = {n: [] for n, _ in new}
            for x in done:
                cols["width"].append(x and x[0][0])
                cols["height"].append(x and sum(f[1] for f in x))
                cols["n_frames"].append(x and len(x))
                cols["thumbnail"].append(x and b"".join(f[2].tobytes() for f in x))
                cols["thumbnail_hash"].append(x and hash_of_frames([f[2] for f in x]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cols[n], t) for n, t in new)], names=[*batch.schema.names, *cols])

    types = "width long, height long, n_frames int, thumbnail binary, thumbnail_hash string"
    return kept.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + types)


def digests(thumbs: DataFrame) -> DataFrame:
    """The digest row of the contract from media and what was read back from it.

    Null or broken media: nulls, but for the size and digest of what is stored.
    """
    tune(thumbs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def each(batch: pa.RecordBatch) -> dict:
        media, read = column(batch, "media").to_pylist(), column(batch, "thumbnail").to_pylist()
        shape = zip(*(column(batch, c).to_pylist() for c in ("width", "height", "n_frames", "thumbnail_hash")), strict=True)
        return {
            "doc_id": column(batch, "doc_id"),
            "n_bytes": column(batch, "n_bytes"),
            "payload_bytes": [None if p is None else len(p) for p in read],
            "payload_sha256": [None if p is None else hashlib.sha256(p).hexdigest() for p in read],
            "tail_crc32": [None if p is None else zlib.crc32(p[-64:]) for p in read],
            "media_bytes": [None if m is None else len(m) for m in media],
            "media_sha256": [None if m is None else hashlib.sha256(m).hexdigest() for m in media],
            "feature": [None if x is None else f"jpeg:{w}x{h}x{n}:{x}" for w, h, n, x in shape],
        }

    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return thumbs.mapInArrow(lambda it: rows(it, schema, each), out)
