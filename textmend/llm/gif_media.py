"""Media columns: GIF bytes in a column, their frames and colour histograms.

``write_gif`` stores 8-bit samples as frames of a GIF with a grey palette, losslessly;
``read_gif`` reads any GIF: sub-blocks, LZW code streams, global and local palettes,
interlacing, transparency, the four disposal rules and frame times.

The LZW reader takes a code's place in the stream as known: the width of the i-th code
since the last clear depends on i alone, so whole segments of codes are cut out of
the bit stream by numpy, and only the strings are built code by code.

Edge cases: a null text is an empty text; an empty text is stored as 64 zero samples;
texts of any length are spread over as many frames as they need; repeated rows give
repeated results; extra columns are kept, new columns take clashing names' place.  A
broken stream raises ``ValueError``.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, table

WIDTH, ROWS, DELAY_CS, UNIT = 64, 256, 10, 64
CLEAR, END, FIRST, LIMIT = 256, 257, 258, 4096
GREY = bytes(v for i in range(256) for v in (i, i, i))


def _widths(first_bits: int, n: int) -> np.ndarray:
    """Width of the i-th code since a clear, for a minimum code size of ``first_bits`` - 1."""
    avail = (1 << (first_bits - 1)) + 1 + np.arange(n)
    return np.minimum(12, np.maximum(first_bits, np.floor(np.log2(avail)).astype(np.int64) + 1))


_CHUNK = 4400
_WIDE = {b: _widths(b, _CHUNK) for b in range(3, 10)}
_AT = {b: np.concatenate([[0], np.cumsum(w)]) for b, w in _WIDE.items()}


def lzw_write(data: bytes) -> bytes:
    """LZW codes of 8-bit samples, packed from the lowest bit."""
    codes, place, starts = [CLEAR], {}, [1]
    get, put, free = place.get, codes.append, FIRST
    p = data[0]
    for b in memoryview(data)[1:]:
        k = p << 8 | b
        c = get(k)
        if c is not None:
            p = c
            continue
        put(p)
        if free < LIMIT:
            place[k] = free
            free += 1
        else:
            put(CLEAR)
            starts.append(len(codes))
            place.clear()
            free = FIRST
        p = b
    put(p)
    put(END)
    c = np.array(codes, np.int64)
    w = np.full(c.size, 9)
    for a, z in zip(starts, [*starts[1:], c.size]):
        w[a:z] = _WIDE[9][: z - a]
    at = np.cumsum(w) - w
    size = int(at[-1] + w[-1] + 7) >> 3
    v, k = c << (at & 7), at >> 3
    # Codes never share a bit, so the bytes are sums of the parts that fall into them.
    out = sum(np.bincount(k + i, v >> 8 * i & 255, size + 2) for i in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_read(raw: bytes, min_bits: int, n: int) -> bytes:
    """The first ``n`` samples of a code stream."""
    clear, end, first = 1 << min_bits, (1 << min_bits) + 1, (1 << min_bits) + 2
    wide, at = _WIDE[min_bits + 1], _AT[min_bits + 1]
    b = np.frombuffer(raw + b"\0\0\0\0", np.uint8).astype(np.int64)
    word = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    out, got, pos, total = [], 0, 0, len(raw) * 8
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    strings, prev = base.copy(), b""
    full = False  # the table is full and no clear has come yet: all codes have 12 bits
    while got < n:
        if full:
            offs, w = pos + 12 * np.arange(_CHUNK), np.full(_CHUNK, 12)
        else:
            offs, w = pos + at[:-1], wide
        k = int(np.searchsorted(offs + w, total, side="right"))
        codes = (word[offs[:k] >> 3] >> (offs[:k] & 7)) & ((1 << w[:k]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        m = int(stop[0]) if stop.size else k
        first_of = len(out)
        size, add, put = len(strings), strings.append, out.append
        for c in codes[:m].tolist():
            if c < size:
                s = strings[c]
            elif c == size and prev:
                s = prev + prev[:1]
            else:
                raise ValueError("a code before its entry")
            if prev and size < LIMIT:
                add(prev + s[:1])
                size += 1
            put(s)
            prev = s
        got += sum(map(len, out[first_of:]))
        if stop.size:
            pos = int(offs[m] + w[m])
            if codes[m] == end:
                break
            strings, prev, full = base.copy(), b"", False
        elif m < _CHUNK:
            break
        else:
            pos, full = int(offs[-1] + w[-1]), True
    if got < n:
        raise ValueError("the code stream ends early")
    return b"".join(out)[:n]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames hold ``samples`` (a positive multiple of ``width``), top left aligned."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    step = width * rows
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, len(samples) // width), 0xF7, 0, 0), GREY]
    for i in range(0, len(samples), step):
        part = samples[i : i + step]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_write(part)))
    return b"".join([*out, b"\x3b"])


def read_gif(data: bytes):
    """Frames of a GIF: (delay in ms, its samples as stored, the canvas as RGB rows)."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    w, h, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    palette = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    ground = palette[back] if palette is not None and back < len(palette) else np.zeros(3, np.uint8)
    canvas = np.empty((h, w, 3), np.uint8)
    canvas[:] = ground
    delay, clear_to, seen = 0, 0, None

    def blocks():
        nonlocal at
        got = []
        while (n := data[at]) != 0:
            got.append(data[at + 1 : at + 1 + n])
            at += n + 1
            if at >= len(data):
                raise ValueError("the file ends early")
        at += 1
        return b"".join(got)

    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            at += 2
            body = blocks()
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                clear_to, seen = bits >> 2 & 7, index if bits & 1 else None
        elif kind == 0x2C:
            x, y, fw, fh, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = palette
            if bits & 0x80:
                n = 3 << ((bits & 7) + 1)
                colours = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
                at += n
            if colours is None:
                raise ValueError("no palette")
            min_bits = data[at]
            at += 1
            samples = lzw_read(blocks(), min_bits, fw * fh)
            px = np.frombuffer(samples, np.uint8).reshape(fh, fw)
            if bits & 0x40:  # rows of an interlaced frame come in four passes
                order = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, fh, d)]
                straight = np.empty_like(px)
                straight[order] = px
                px = straight
            kept = canvas.copy() if clear_to == 3 else None
            spot = canvas[y : y + fh, x : x + fw]
            inner = px[: spot.shape[0], : spot.shape[1]]
            rgb = colours[np.minimum(inner, len(colours) - 1)]
            if seen is None:
                spot[:] = rgb
            else:
                shown = inner != seen
                spot[shown] = rgb[shown]
            yield delay * 10, px.tobytes(), canvas
            if clear_to == 2:
                canvas[y : y + fh, x : x + fw] = ground
            elif clear_to == 3:
                canvas = kept
            delay, clear_to, seen = 0, 0, None
        else:
            raise ValueError("unknown block")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by colour, two bits a channel."""
    c = canvas >> 6
    return np.bincount((c[..., 0] << 4 | c[..., 1] << 2 | c[..., 2]).ravel(), minlength=64)


FRAME = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("delay_ms", T.IntegerType()), T.StructField("pixels", T.LongType()), T.StructField("histogram", T.ArrayType(T.LongType()))])
_ARROW_FRAME = pa.struct([("ord", pa.int32()), ("delay_ms", pa.int32()), ("pixels", pa.int64()), ("histogram", pa.list_(pa.int64()))])


def _mapped(df: DataFrame, used: str, new: list[T.StructField], make, rows: int = 128) -> DataFrame:
    """``df`` without clashing columns, plus the columns that ``make`` gives for lists of ``used``."""
    names = {f.name for f in new}
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([*[df.schema[c] for c in keep], *new])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cols = make(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *cols], names=[*keep, *[f.name for f in new]])

    return arrow_map(df.select(*keep, F.col(used).alias("__used")), run, schema)


def text_to_media(docs: DataFrame, *, text_col="text") -> DataFrame:
    """``docs`` with media: the text's bytes, zero-padded, as a GIF."""

    def make(texts):
        out = []
        for t in texts:
            raw = t.encode() if t else b""
            out.append(write_gif(raw + b"\0" * ((-len(raw)) % UNIT or (0 if raw else UNIT))))
        return [pa.array(out, pa.binary())]

    return _mapped(docs, text_col, [T.StructField("media", T.BinaryType())], make)


def media_columns(media: DataFrame, *, media_col="media") -> DataFrame:
    """``media`` with payload (all frames' samples), frames (timed, with histograms) and feature."""

    def make(blobs):
        payload, frames = [], []
        for blob in blobs:
            if blob is None:
                payload.append(None)
                frames.append(None)
                continue
            parts, got = [], []
            for i, (ms, samples, canvas) in enumerate(read_gif(blob)):
                parts.append(samples)
                got.append({"ord": i, "delay_ms": ms, "pixels": len(samples), "histogram": histogram(canvas)})
            payload.append(b"".join(parts))
            frames.append(got)
        return [pa.array(payload, pa.binary()), pa.array(frames, pa.list_(_ARROW_FRAME))]

    out = _mapped(media, media_col, [T.StructField("payload", T.BinaryType()), T.StructField("frames", T.ArrayType(FRAME))], make)
    total = F.aggregate("frames", F.lit(0), lambda a, f: a + f["delay_ms"])
    hist = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 64), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    filled = F.filter(F.transform(hist, lambda v, i: F.concat(i.cast("string"), F.lit(":"), v.cast("string"))), lambda s: ~F.endswith(s, F.lit(":0")))
    return out.withColumn("feature", F.concat(F.size("frames").cast("string"), F.lit("f;"), total.cast("string"), F.lit("ms;"), F.array_join(filled, ",")))


def op4_media_gif(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    stored = text_to_media(docs.withColumn("n_bytes", n)).select("doc_id", "n_bytes", "media")
    back = media_columns(stored)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )
