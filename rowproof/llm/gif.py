"""GIF media columns: LZW code streams, palettes, disposal, transparency and timed frames.

`encode_payloads` stores bytes losslessly as the 8-bit palette indexes of an animated GIF; `decode_frames`
reads any GIF column back: it parses the blocks, inflates each LZW stream, undoes interlacing, applies the
local or global palette, composes the canvas by the disposal and transparency rules, and stores one struct per
timed frame with a colour histogram of the canvas shown. `histogram` counts the area of every frame once, all frames together.

Defined cases: a null medium has no frames and null samples; a broken or truncated medium keeps the frames
before the fault and names it in `error`; equal bytes give equal results; frames that reach over the canvas
are clipped when composed, while their samples stay whole; a delay of zero is stored as zero; a canvas or frame of more than
MAX_PIXELS is a fault; texts of any length are stored whole, in as many frames as they need; an empty table gives no rows; extra columns
are not carried unless `keep` names them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row of the stored frames, and the padding value and unit of a payload.
UNIT, PAD = 576, 255
#: Rows in a stored frame, so that a long payload becomes several timed frames.
FRAME_ROWS = 64
DELAY_MS = 100
#: The largest canvas or frame that is read, in pixels: its header alone asks for four bytes each.
MAX_PIXELS = 1 << 26
MOST_CODES = 4096
#: Histogram bins: two bits of each colour channel.
BINS = 64


def palette_332() -> np.ndarray:
    """256 distinct colours by rule: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


def _code_widths(min_size: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code."""
    top = (1 << min_size) + 1 + np.arange(n)
    top[:1] = 1 << min_size
    return np.minimum(np.floor(np.log2(top)).astype(np.int64) + 1, 12)


WIDTHS = {m: _code_widths(m, MOST_CODES) for m in range(2, 9)}
#: Codes that a stream of 8-bit samples adds between two clear codes, with that which no longer fits, and those of the samples; all eight bits up.
FREE, RAISED = range(258 << 8, (MOST_CODES << 8) + 1, 1 << 8), [i << 8 for i in range(256)]
OFFSETS = {m: np.concatenate([[0], np.cumsum(w)]) for m, w in WIDTHS.items()}


def lzw_compress(data: bytes) -> bytes:
    """The LZW stream of 8-bit samples, with a clear code whenever the table is full."""
    clear, end = 256 << 8, 257 << 8  # codes stand eight bits up, so that a code and a sample add up to a key
    codes, starts = [clear], [1]
    put = codes.append
    samples = iter(data)
    word = next(samples, None)
    if word is not None:
        word <<= 8
    while word is not None:  # once for each clear code
        table: dict[int, int] = {}
        for free in FREE:
            for sample in samples:
                key = word + sample
                if key in table:
                    word = table[key]
                else:
                    break
            else:
                put(word)
                word = None
                break
            put(word)
            table[key] = free
            word = RAISED[sample]
        else:
            put(clear)
            starts.append(len(codes))
    put(end)
    at = np.arange(len(codes)) - np.repeat([0, *starts], np.diff([0, *starts, len(codes)]))
    widths = WIDTHS[8][np.minimum(at, MOST_CODES - 1)]
    widths[0] = 9
    bits = np.unpackbits((np.array(codes) >> 8).astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def _strings(codes: np.ndarray, clear: int, most: int, skip: int = 0) -> bytes:
    """The samples of the codes between two clear codes, without those of the first `skip` codes and `most` at most.

    The k-th code after the end code names the k-th string and the sample after it, so that each sample is found
    by following such references, all at once and doubled, back to a code that is a sample itself.
    """
    place, named = np.arange(len(codes)), codes - (clear + 2)
    if codes[0] >= clear:
        raise ValueError(f"code {codes[0]} comes first")
    beyond = named >= place
    if beyond.any():
        raise ValueError(f"code {codes[beyond.argmax()]} is beyond the table")
    deep = named >= 0
    back = up = np.where(deep, named, place)
    lengths, steps = deep.astype(np.int64), 0
    while deep.take(up).any():
        lengths += lengths.take(up)
        up, steps = up.take(up), steps + 1
    lengths += 1
    ends = lengths.cumsum()
    starts = ends - lengths
    first = int(starts[skip])
    size = min(int(ends[-1]), first + most)
    source = np.arange(size) - (starts - starts.take(back)).repeat(lengths)[:size]
    heads = starts[: starts.searchsorted(size)]
    source[heads] = heads
    for _ in range(steps):  # a sample is no deeper than its code
        source = source.take(source)
    out = np.zeros(size, np.uint8)
    out[heads] = codes.take(up[: len(heads)])
    return out.take(source[first:]).tobytes()


def lzw_expand(data: bytes, min_size: int, most: int) -> bytes:
    """The samples of an LZW stream, `most` at most; a stream may end without its end code."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    n_bits, at, made, left = 8 * len(data), 0, 0, most
    widths, offsets = WIDTHS[min_size], OFFSETS[min_size]
    out: list[bytes] = []
    none = table = np.zeros(0, np.int64)  # the codes since the last clear code, as far as they make the table
    room = MOST_CODES - clear - 1  # codes after a clear code until the table is full
    while at < n_bits and made < most:
        if not len(table):
            n = min(int(np.searchsorted(offsets, n_bits - at, "right")) - 1, room)
            where, wide = at + offsets[:n], widths[:n]
        else:  # the table is full and no clear code has come: twelve bits each
            n = min((n_bits - at) // 12, MOST_CODES)
            where, wide = at + 12 * np.arange(n), np.full(n, 12)
        if n <= 0:
            break
        byte = where >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7)) & ((1 << wide) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        last = int(stop[0]) if len(stop) else n
        if last:
            out.append(_strings(np.concatenate([table, codes[:last]]), clear, left, len(table)))
            left -= len(out[-1])
        made += last  # a lower bound
        if last < n:
            if codes[last] == end:
                break
            at, table = int(where[last] + wide[last]), none
        else:
            at, table = int(where[-1] + wide[-1]), table if len(table) else codes
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(samples: bytes, width: int = UNIT, frame_rows: int = FRAME_ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """An animation whose frames hold the samples in row order; each frame replaces the rows it covers."""
    rows = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), palette_332().tobytes()]
    for top in range(0, rows, frame_rows):
        part = samples[top * width : (top + frame_rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_ms // 10, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(_blocks(lzw_compress(part)))
    return b"".join([*out, b"\x3b"])


class Frame(NamedTuple):
    start_ms: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    samples: bytes
    canvas: np.ndarray  # height x width x 4 as shown, alpha last


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)

    def palette(self, flags: int) -> np.ndarray | None:
        if not flags & 0x80:
            return None
        return np.frombuffer(self.take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3)


def _row_order(height: int) -> np.ndarray:
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF; raises ValueError at a fault, after the frames before it."""
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    wide, high, flags, _, _ = struct.unpack("<HHBBB", r.take(7))
    shared = r.palette(flags)
    if wide * high > MAX_PIXELS:
        raise ValueError(f"a canvas of {wide} x {high} pixels")
    canvas = np.zeros((high, wide, 4), np.uint8)
    clock, disposal, delay, clear_index = 0, 0, 0, -1
    while (kind := r.take(1)[0]) != 0x3B:
        if kind == 0x21:
            label, body = r.take(1)[0], r.blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack("<BHB", body[:4])
                disposal, delay, clear_index = packed >> 2 & 7, 10 * hundredths, index if packed & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, w, h, flags = struct.unpack("<HHHHB", r.take(9))
        if w * h > MAX_PIXELS:
            raise ValueError(f"a frame of {w} x {h} pixels")
        local = r.palette(flags)
        colours = shared if local is None else local
        if colours is None:
            colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
        min_size = r.take(1)[0]
        if not 2 <= min_size <= 8:
            raise ValueError(f"code size {min_size}")
        samples = lzw_expand(r.blocks(), min_size, w * h)
        if len(samples) < w * h:
            raise ValueError("a frame is cut short")
        index = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 0x40:
            plain = np.empty_like(index)
            plain[_row_order(h)] = index
            index, samples = plain, plain.tobytes()
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = index[: area.shape[0], : area.shape[1]]
        rgba = np.full((256, 4), 255, np.uint8)
        rgba[: len(colours), :3] = colours
        if clear_index >= 0:
            painted = shown != clear_index
            area[painted] = rgba[shown[painted]]
        else:
            area[:] = rgba[shown]
        yield Frame(clock, delay, disposal, left, top, w, h, samples, canvas.copy())
        clock += delay
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear_index = 0, 0, -1


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the opaque pixels by two bits of red, green and blue."""
    flat = canvas.reshape(-1, 4).view("<u4").ravel()
    bins = (flat >> 6 & 3) << 4 | (flat >> 14 & 3) << 2 | flat >> 22 & 3
    opaque = flat >> 24 > 0
    return np.bincount(bins if opaque.all() else bins[opaque], minlength=BINS)[:BINS]


def encode_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, `n_bytes` of the text in UTF-8 and `media`, the GIF that holds its padded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, media = [], []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n.append(len(raw))
                media.append(write_gif(raw + bytes([PAD]) * (UNIT - len(raw) if not raw else -len(raw) % UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


FRAME_TYPE = pa.struct([(k, pa.int32()) for k in ("start_ms", "delay_ms", "disposal", "left", "top", "width", "height")] + [("histogram", pa.list_(pa.int32()))])
FRAME_DDL = "array<struct<start_ms:int,delay_ms:int,disposal:int,left:int,top:int,width:int,height:int,histogram:array<int>>>"


def decode_frames(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns in `keep`, `media`, `frames` (timed, with histograms), `histogram` (all frames' areas), `samples` (all frames' indexes in order) and `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, totals, samples, errors = [], [], [], []
            for blob in batch.column(batch.num_columns - 1).to_pylist():
                timed, total, parts, error = [], np.zeros(BINS, np.int64), [], None
                try:
                    for f in read_gif(blob) if blob is not None else ():
                        timed.append({**{k: getattr(f, k) for k in ("start_ms", "delay_ms", "disposal", "left", "top", "width", "height")}, "histogram": colour_histogram(f.canvas).tolist()})
                        total += colour_histogram(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width].copy())
                        parts.append(f.samples)
                except ValueError as e:
                    error = str(e)
                frames.append(timed)
                totals.append(total.tolist())
                samples.append(None if blob is None else b"".join(parts))
                errors.append(error)
            made = [pa.array(frames, pa.list_(FRAME_TYPE)), pa.array(totals, pa.list_(pa.int64())), pa.array(samples, pa.binary()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "frames", "histogram", "samples", "error"])

    names = [*keep, "media"]
    kinds = "".join(f"`{k}` {media.schema[k].dataType.simpleString()}, " for k in keep)
    return media.select(*keep, F.col(media_col).alias("media")).mapInArrow(run, f"{kinds}media binary, frames {FRAME_DDL}, histogram array<long>, samples binary, error string")


def digests(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF, read it back, and derive hashes and a feature text."""
    seen = decode_frames(encode_payloads(docs), ["doc_id", "n_bytes"])
    return seen.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, length(samples) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("frames="), F.size("frames")),
            F.concat(F.lit("ms="), F.expr("aggregate(frames, 0, (a, f) -> a + f.delay_ms)")),
            F.concat(F.lit("hist="), F.array_join(F.col("histogram").cast("array<string>"), ",")),
        ).alias("feature"),
        "error",
    )
