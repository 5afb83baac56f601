"""Operator 4, media columns: GIF images as tables of frames.

`read_frames` parses a GIF and decodes its LZW code streams (codes that grow from the least size to 12 bits, clear and end codes, the code that
is not yet in the table, interlacing), composes every frame on the canvas by local or global palette, transparency and disposal, and yields
when it is shown, for how long, and a colour histogram. `write_gif` makes GIFs of 8-bit samples, whose own indices any bytes can be.

Cases: null and empty texts are one row of 64 zero samples; equal texts give equal bytes, and repeated rows stay as many; a long text is as many
frames of 1024 rows as it needs; an empty table gives no rows; other columns stay, but one named like a result is replaced; a file cut short, or
with a code out of range, raises ValueError in `read_frames`, and `frames` gives such a row one frame row with `error` set, and one of null bytes
none at all.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm.common import add_columns, keyed, saved, slices, table

WIDTH = 64
#: Rows of samples in a frame at most.
ROWS = 1024
#: Fixed values of the format: most bits of a code; first row and step of the four passes of interlacing.
MOST_BITS = 12
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
#: Bits of each channel that count in a histogram's bin.
BIN_BITS = 2
#: The palette of samples: 3 bits of red, 3 of green, 2 of blue.
_I = np.arange(256)
PALETTE = np.stack(((_I >> 5) * 255 // 7, (_I >> 2 & 7) * 255 // 7, (_I & 3) * 255 // 3), axis=1).astype(np.uint8)


def code_widths(n: int, least: int) -> np.ndarray:
    """Bits of the first n codes after a clear code. The table, from its clear and end codes on, grows by one entry a code from the second on."""
    entries = np.arange(n) + (1 << least) + 1
    bits = np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1
    return np.minimum(np.maximum(bits, least + 1), MOST_BITS)


_WIDTHS = {least: code_widths(1 << 17, least) for least in range(2, 9)}


def pack_codes(codes: list[int], widths: np.ndarray) -> bytes:
    """Codes of the given bits, least bit first."""
    ends = np.cumsum(widths)
    value = np.array(codes, np.uint64) << ((ends - widths) & 7).astype(np.uint64)
    byte, out = (ends - widths) >> 3, np.zeros(int(ends[-1] + 7 >> 3) + 2, np.int64)
    for k in range(3):
        out += np.bincount(byte + k, weights=(value >> np.uint64(8 * k) & np.uint64(255)).astype(np.float64), minlength=len(out)).astype(np.int64)
    return out[: int(ends[-1] + 7 >> 3)].astype(np.uint8).tobytes()


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples: longest known prefixes, a clear code first and whenever the table is full."""
    codes, lengths = [], []
    add, known, free, since = codes.append, {}, 258, 0
    find = known.get
    rest = iter(samples)
    prefix = next(rest, -1)
    for sample in rest:
        key = prefix << 8 | sample
        code = find(key)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        prefix = sample
        if free < 4096:
            known[key] = free
            free += 1
        else:
            add(256)
            lengths.append(len(codes) - since)
            since = len(codes)
            known.clear()
            free = 258
    if prefix >= 0:
        add(prefix)
    add(257)
    lengths.append(len(codes) - since)
    return pack_codes([256, *codes], np.concatenate(([9], *(_WIDTHS[8][:n] for n in lengths))))


def unpack_codes(stream: np.ndarray, bit: int, widths: np.ndarray) -> np.ndarray:
    """Codes from a bit on, as many as the stream holds in full. stream: bytes, three zeros behind them."""
    ends = bit + np.cumsum(widths)
    n = int(np.searchsorted(ends, (len(stream) - 3) * 8, side="right"))
    at = ends[:n] - widths[:n]
    byte = at >> 3
    value = stream[byte].astype(np.int64) | stream[byte + 1].astype(np.int64) << 8 | stream[byte + 2].astype(np.int64) << 16
    return value >> (at & 7) & (1 << widths[:n]) - 1


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """The first `most` samples of a code stream."""
    data = np.frombuffer(stream + b"\0\0\0", np.uint8)
    clear, end = 1 << least, (1 << least) + 1
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    bit, size = 0, 0
    widths = _WIDTHS[least]
    step = 4096
    while size < most:
        codes = unpack_codes(data, bit, widths[:step])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops) and len(codes) == step and step < len(widths):
            step = len(widths)  # a table that stays full for long
            continue
        n = int(stops[0]) if len(stops) else len(codes)
        known, held = roots.copy(), codes[:n].tolist()
        learn, give, free = known.append, out.append, clear + 2
        before = b""
        for code in held:
            if code < free and (before or code < clear):
                now = known[code]
                if before and free < 4096:
                    learn(before + now[:1])
                    free += 1
            elif before and code == free < 4096:
                now = before + before[:1]
                learn(now)
                free += 1
            else:
                raise ValueError("code out of range")
            give(now)
            before = now
        size = sum(map(len, out)) if len(stops) and codes[n] == clear else most
        if not len(stops) or codes[n] == end:
            break
        bit += int(widths[: n + 1].sum())
        step = 4096
    joined = b"".join(out)
    if len(joined) < most:
        raise ValueError("samples are missing")
    return joined[:most]


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def write_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = 10) -> bytes:
    """A GIF of 8-bit samples, a multiple of `width` of them: frames of up to `rows` rows, each shown for `delay` hundredths of a second."""
    height = min(rows, len(samples) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), PALETTE.tobytes()]
    for at in range(0, len(samples), width * rows):
        some = samples[at : at + width * rows]
        parts += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(some) // width, 0), b"\x08", blocks(lzw_encode(some))]
    return b"".join(parts) + b"\x3b"


@dataclass
class Frame:
    number: int
    at_ms: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    samples: np.ndarray
    canvas: np.ndarray | None

    def histogram(self) -> np.ndarray:
        """Pixels of the canvas in each colour bin."""
        bins = self.canvas[..., :3].astype(np.int64) >> 8 - BIN_BITS
        return np.bincount((bins[..., 0] << 2 * BIN_BITS | bins[..., 1] << BIN_BITS | bins[..., 2]).ravel(), minlength=1 << 3 * BIN_BITS)


def read_frames(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """The frames of a GIF in order. Without `compose` their canvas is None."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None

    def colours(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        if at + 3 * n > len(data):
            raise ValueError("cut short")
        at += 3 * n
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(-1, 3)

    def chunks() -> list[bytes]:
        nonlocal at
        out = []
        while True:
            if at >= len(data):
                raise ValueError("cut short")
            n = data[at]
            at += 1 + n
            if not n:
                return out
            out.append(data[at - n : at])

    if flags & 0x80:
        palette = colours(flags & 7)
    canvas = np.zeros((high, wide, 4), np.uint8) if compose else None
    shown, number, disposal, delay, clear = 0, 0, 0, 0, None
    while True:
        if at >= len(data):
            raise ValueError("cut short")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            got = chunks()
            if label == 0xF9 and got and len(got[0]) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", got[0])
                disposal, delay, clear = packed >> 2 & 7, hundredths * 10, index if packed & 1 else None
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise ValueError("cut short" if kind == 0x2C else "unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        own = colours(flags & 7) if flags & 0x80 else palette
        least = data[at]
        at += 1
        if not 2 <= least <= 8:
            raise ValueError("code size out of range")
        samples = np.frombuffer(lzw_decode(b"".join(chunks()), least, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in PASSES])
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        if compose:
            if own is None:
                raise ValueError("no palette")
            kept = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            inside = samples[: part.shape[0], : part.shape[1]]
            if inside.size and int(inside.max()) >= len(own) and (clear is None or (inside[inside != clear] >= len(own)).any()):
                raise ValueError("colour out of range")
            seen = inside != clear if clear is not None else np.ones(inside.shape, bool)
            part[seen, :3], part[seen, 3] = own[np.minimum(inside, len(own) - 1)][seen], 255
        yield Frame(number, shown, delay, disposal, left, top, w, h, samples, canvas.copy() if compose else None)
        if compose and disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif compose and disposal == 3:
            canvas = kept
        shown, number = shown + delay, number + 1
        disposal, delay, clear = 0, 0, None


FRAMES = "frame int, at_ms long, delay_ms long, disposal int, left int, top int, width int, height int, samples binary, canvas binary, histogram array<int>, error string"


def frames(df: DataFrame, key: str = "id", media: str = "media") -> DataFrame:
    """A row a frame: the key, when and where the frame is shown, its samples, the RGBA canvas with it, and the canvas's colour histogram."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(FRAMES).names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            for k, data in enumerate(batch["media"].to_pylist()):
                if data is None:
                    continue
                try:
                    for f in read_frames(data):
                        yield row(batch, k, [f.number, f.at_ms, f.delay_ms, f.disposal, f.left, f.top, f.width, f.height, f.samples.tobytes(), f.canvas.tobytes(), f.histogram().tolist(), None])
                except ValueError as e:
                    yield row(batch, k, [*[None] * 11, str(e)])

    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.string()]

    def row(batch: pa.RecordBatch, k: int, values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["id"].slice(k, 1), *(pa.array([v], t) for v, t in zip(values, kinds, strict=True))], names=["id", *names])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("id"), F.col(media).cast("binary").alias("media")).mapInArrow(rows, f"id {kind}, {FRAMES}")
    return out.withColumnRenamed("id", key)


def store_text(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with a GIF whose samples are the text's UTF-8 bytes, then zero bytes up to a positive multiple of 64."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        got = []
        for x in batch[text].to_pylist():
            data = (x or "").encode("utf-8", "replace")
            got.append(write_gif(data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))))
        return {out: pa.array(got, pa.binary())}

    return add_columns(df, make, {out: "binary"})


STORED = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def stored_features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with digests of the samples read back from a GIF, and as feature the frames, the time shown and, of every frame, `at_ms:histogram`, the
    colours of its canvas as the file's palette, transparency and disposal make it (bins that are not empty, as bin=pixels)."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = []
        for data in batch[media].to_pylist():
            payload, timed, shown = [], [], 0
            for f in read_frames(data):
                counts = f.histogram()
                payload.append(f.samples.tobytes())
                timed.append(f"{f.at_ms}:" + ",".join(f"{k}={counts[k]}" for k in np.flatnonzero(counts).tolist()))
                shown += f.delay_ms
            payload = b"".join(payload)
            feature = f"{len(timed)} {shown} " + ";".join(timed)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        return {k: pa.array(v, pa.int64() if kind == "long" else pa.string()) for (k, kind), v in zip(STORED.items(), zip(*rows, strict=True) if rows else [[]] * len(STORED), strict=True)}

    return add_columns(df, make, STORED)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is written as a GIF to a table of files, and all but its id and size is computed from the bytes read back from there."""
    docs = keyed(table(spark, sf_dir, "documents")).select("doc_id", "text")
    stored = store_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media")
    return stored_features(saved(stored, "media")).drop("media")
