import hashlib
import struct
import zlib

import numpy as np
import pytest

from forumetry.llm import gif

from .helpers import documents, store


def slow_decode(stream, least):
    """LZW bit by bit, as the format's description has it."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, end, out, at = 1 << least, (1 << least) + 1, b"", 0
    known, width, before = {}, least + 1, None
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            known, width, before = {**{k: bytes([k]) for k in range(clear)}, clear: b"", end: b""}, least + 1, None
            continue
        if code == end:
            break
        now = known[code] if code in known else before + before[:1]
        if before is not None and len(known) < 4096:
            known[len(known)] = before + now[:1]
            if len(known) == 1 << width and width < 12:
                width += 1
        out, before = out + now, now
    return out


@pytest.mark.parametrize("n,kinds", [(1, 1), (64, 1), (5000, 2), (40_000, 256), (60_000, 30), (300, 256)])
def test_lzw_round_trip(n, kinds):
    data = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint8).tobytes()
    stream = gif.lzw_encode(data)
    assert gif.lzw_decode(stream, 8, n) == data
    if n <= 40_000:
        assert slow_decode(stream, 8) == data


def image(frames, size=(4, 4), palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    """frames: (left, top, w, h, samples, delay, disposal, transparent or None, interlaced, own palette or None)."""
    pal = lambda p: bytes(c for x in p for c in x)
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + pal(palette)
    for left, top, w, h, samples, delay, disposal, clear, laced, own in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0)
        out += b"\x21\xfe\x03abc\x00\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x40 if laced else 0) | (0x81 if own else 0)) + (pal(own) if own else b"")
        codes = [4]
        for x in samples:  # a clear code before every two samples keeps the codes at 3 bits
            codes += [x, 4]
        codes += [5]
        bits = "".join(f"{c:03b}"[::-1] for c in codes)
        bits += "0" * (-len(bits) % 8)
        out += b"\x02" + gif.blocks(bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8)))
    return out + b"\x3b"


def test_frames_palettes_disposal_transparency(spark):
    full = [0] * 16
    data = image([
        (0, 0, 4, 4, full, 5, 1, None, False, None),
        (1, 1, 2, 2, [1, 3, 3, 1], 7, 3, 3, False, None),  # transparent 3, restored afterwards
        (0, 0, 2, 2, [2, 2, 2, 2], 9, 2, None, False, None),  # background afterwards
        (2, 0, 2, 4, [0, 0, 1, 1, 2, 2, 3, 3], 1, 0, None, True, ((1, 1, 1), (2, 2, 2), (3, 3, 3), (200, 200, 200))),
    ])
    a, b, c, d = gif.read_frames(data)
    assert (a.canvas[..., :3] == (255, 0, 0)).all() and [x.at_ms for x in (a, b, c, d)] == [0, 50, 120, 210]
    assert b.canvas[1, 1].tolist() == [0, 255, 0, 255] and b.canvas[1, 2].tolist() == [255, 0, 0, 255]
    assert c.canvas[1, 1].tolist() == [0, 0, 255, 255] and c.canvas[2, 2].tolist() == [255, 0, 0, 255]
    assert d.canvas[0, 0].tolist() == [0, 0, 0, 0] and d.canvas[:, 2, 0].tolist() == [1, 3, 2, 200]
    assert a.histogram()[0b110000] == 16
    rows = gif.frames(spark.createDataFrame([(1, data), (2, None), (3, b"GIF89a"), (4, data[:60])], "id long, media binary")).collect()
    assert [(r.id, r.frame) for r in rows if r.error is None] == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert sorted(r.id for r in rows if r.error) == [3, 4] and all(sum(r.histogram) == 16 for r in rows if r.error is None)


def test_op4(spark, sf, tmp_path):
    for folder in (sf, store(documents(spark), tmp_path)):
        want = {}
        for doc, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
            data = (text or "").encode()
            padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            want[doc] = (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        rows = gif.op4_gif_media(spark, folder).collect()
        assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
        assert len({(r.payload_sha256, r.n_bytes) for r in rows}) == len({r[3:] + (r.n_bytes,) for r in rows})
    assert gif.op4_gif_media(spark, store(documents(spark).limit(0), tmp_path / "none")).count() == 0


def test_op4_feature_is_of_the_canvas(spark):
    full = [0] * 16
    data = image([(0, 0, 4, 4, full, 5, 1, None, False, None), (1, 1, 2, 2, [1, 3, 3, 1], 7, 3, 3, False, None), (2, 0, 2, 4, [0, 0, 1, 1, 2, 2, 3, 3], 1, 0, None, True, ((1, 1, 1), (2, 2, 2), (3, 3, 3), (200, 200, 200)))])
    row = gif.stored_features(spark.createDataFrame([(1, data)], "id long, media binary")).first()
    assert row.feature == "3 130 0:48=16;50:12=2,48=14;120:0=6,48=8,63=2"


def test_long_text_has_many_frames():
    data = bytes(range(256)) * 1000
    shown = list(gif.read_frames(gif.write_gif(data), compose=False))
    assert len(shown) == 4 and b"".join(f.samples.tobytes() for f in shown) == data
