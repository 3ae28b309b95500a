import hashlib
import os
import struct

import numpy as np
import pytest

from filescope.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 64 * media.ROWS + 1])
def test_round_trip(n):
    payload = media.pad(os.urandom(n))
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
    frames = media.thumbnails([media.encode(payload)])[0]
    assert b"".join(t.tobytes() for _, _, t in frames) == payload


def _bits(values):
    s = "".join(f"{v:0{n}b}" for v, n in values)
    s += "1" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\0")


def test_foreign_jpeg_with_colour_subsampling_ac_and_no_restarts():
    """A hand-made 4:2:0 image: the luminance DC grid comes out in block order, AC symbols are skipped."""
    dc = (bytes([0, 1, 5, 1, 1] + [0] * 11), bytes([0, 1, 2, 3, 4, 5, 6, 7]))
    ac = (bytes([0, 2, 1] + [0] * 13), bytes([0x00, 0x01, 0xF0]))
    code = {s: (c, n) for s, n, c in media._huffman_codes(*dc)}
    acode = {s: (c, n) for s, n, c in media._huffman_codes(*ac)}
    rng = np.random.default_rng(1)
    grid = rng.integers(-50, 50, (4, 6))
    bits, pred = [], [0, 0, 0]

    def block(c, value):
        d, pred[c] = int(value) - pred[c], int(value)
        size = abs(d).bit_length()
        bits.append(code[size])
        if size:
            bits.append((d if d > 0 else d + (1 << size) - 1, size))
        bits.extend([acode[0xF0], acode[0x01], (1, 1), acode[0x00]])

    for y in range(0, 4, 2):
        for x in range(0, 6, 2):
            for v in range(2):
                for h in range(2):
                    block(0, grid[y + v, x + h])
            block(1, 3)
            block(2, -3)
    seg = media._segment
    data = (
        b"\xff\xd8"
        + seg(0xDB, bytes([0]) + bytes([8] * 64))
        + seg(0xC0, struct.pack(">BHHB", 8, 32, 48, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + seg(0xC4, b"\0" + dc[0] + dc[1])
        + seg(0xC4, b"\x10" + ac[0] + ac[1])
        + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
        + _bits(bits)
        + b"\xff\xd9"
    )
    ((w, h, thumb),) = media.thumbnails([data])[0]
    assert (w, h) == (48, 32)
    assert (thumb.astype(int) - 128 == grid).all()
    for n in (3, 50, len(data) - 40):
        media.thumbnails([data[:n]])  # truncated: no crash


def test_broken_media_is_null(spark):
    df = spark.createDataFrame([(1, b"x"), (2, None), (3, media.encode(bytes(64)))], "id long, media binary")
    got = {r["id"]: r for r in media.thumbnail_columns(df).collect()}
    assert got[1]["width"] is None and got[2]["thumbnail"] is None
    assert (got[3]["width"], got[3]["height"], got[3]["n_frames"]) == (512, 8, 1)
    sizes = media.thumbnail_columns(df.selectExpr("id as doc_id", "length(media) as n_bytes", "media"))
    rows = {r["doc_id"]: r for r in media.digests(sizes).collect()}
    assert rows[1]["payload_sha256"] is None and rows[1]["media_bytes"] == 1 and rows[1]["feature"] is None
    assert rows[2]["media_sha256"] is None and rows[2]["payload_bytes"] is None and rows[3]["payload_bytes"] == 64


def test_thumbnail_hash_by_its_definition():
    rng = np.random.default_rng(3)
    for high, wide in ((1, 64), (2, 64), (8, 8), (9, 64), (37, 5), (200, 64)):
        thumb = rng.integers(0, 256, (high, wide)).astype(np.uint8)
        cells = []
        for r in range(8):
            for c in range(8):
                top, left = high * r // 8, wide * c // 8
                cells.append(thumb[top : max(top + 1, high * (r + 1) // 8), left : max(left + 1, wide * (c + 1) // 8)].mean())
        mean = sum(cells) / 64
        assert f"{media.thumbnail_hash(thumb):064b}" == "".join("1" if x > mean + 1e-9 else "0" for x in cells)


def test_digests(spark):
    texts = [(1, "aé\U0001f600" * 100, 5), (2, None, 6), (3, "", 7), (4, "x" * 700_000, 8), (4, "x" * 700_000, 8), (None, "null id", 9)]
    df = spark.createDataFrame(texts, "doc_id long, text string, media int")
    out = media.digests(media.thumbnail_columns(media.encode_columns(df))).collect()
    assert len(out) == 6
    for doc, text, _ in texts:
        for r in (r for r in out if r["doc_id"] == doc):
            p = media.pad((text or "").encode())
            assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["n_bytes"] == len((text or "").encode())
            assert r["media_sha256"] == hashlib.sha256(media.encode(p)).hexdigest() and r["payload_bytes"] == len(p)
    assert media.digests(media.thumbnail_columns(media.encode_columns(df.limit(0)))).count() == 0


def test_every_frame_enters_the_feature(spark):
    # Over 524,224 bytes: two frames, the first the same in all.
    first = "a" * 8191 * 64
    df = spark.createDataFrame([(1, first + "b" * 64), (2, first + "c" * 64), (3, first + "b" * 63 + "c"), (4, first + "b" * 64)], "doc_id long, text string")
    got = {r["doc_id"]: r["feature"] for r in media.digests(media.thumbnail_columns(media.encode_columns(df))).collect()}
    assert got[1] == got[4] and len({got[1], got[2], got[3]}) == 3
