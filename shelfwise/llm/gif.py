"""GIF media columns: LZW streams, palettes, disposal and transparency, timed frames.

``decode_gif`` reads any GIF87a or GIF89a file into composed frames. ``encode_gif`` writes
one from 8-bit samples, losslessly, with real LZW compression. Both keep one image in memory.
Code packing and unpacking is vectorised; the string table is a plain dictionary loop.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GREY = bytes(x for i in range(256) for x in (i, i, i))
#: Rows of samples in one frame, and its time in hundredths of a second, as ``encode_gif`` cuts them.
FRAME_ROWS, FRAME_DELAY = 256, 4
MAX_BITS = 12
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _widths(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit widths of the codes after a clear code, by position, and the bits before each.

    A reader has added one string fewer than it has read codes; codes get a bit wider when
    the next string's number needs it. Positions past the end all have 12 bits.
    """
    if size not in _TABLES:
        first = (1 << size) + 2
        n = (1 << MAX_BITS) - first + 2
        nexts = first + np.maximum(0, np.arange(n) - 1)
        widths = np.minimum(MAX_BITS, np.maximum(size + 1, np.floor(np.log2(nexts)).astype(np.int64) + 1))
        _TABLES[size] = widths, np.concatenate(([0], np.cumsum(widths)))
    return _TABLES[size]


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """An LZW code stream: a clear code first and whenever the table is full, an end code last."""
    clear, end, full = 1 << size, (1 << size) + 1, 1 << MAX_BITS
    codes: list[int] = []
    marks = [0]  # where each run after a clear code begins
    put = codes.append
    singles = {chr(i): i for i in range(clear)}  # strings of Latin-1 stand for samples: they add up fast
    table, free = singles.copy(), end + 1
    now = ""
    for sample in data.decode("latin-1"):
        longer = now + sample
        if longer in table:
            now = longer
        else:
            put(table[now])
            table[longer] = free
            free += 1
            now = sample
            if free == full:
                put(clear)
                marks.append(len(codes))
                table, free = singles.copy(), end + 1
    if now:
        put(table[now])
    put(end)
    table_widths = _widths(size)[0]
    widths = np.empty(len(codes) + 1, dtype=np.uint8)
    widths[0] = size + 1
    for a, b in zip(marks, [*marks[1:], len(codes)], strict=True):
        widths[a + 1 : b + 1] = table_widths[: b - a]
    values = np.array([clear, *codes], dtype="<u2")
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16, dtype=np.uint8) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """The samples of a code stream. Raises ValueError on a code that can't occur."""
    clear, end, full = 1 << size, (1 << size) + 1, 1 << MAX_BITS
    raw = np.concatenate((np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8))).astype(np.uint32)
    total = len(data) * 8
    widths, before = _widths(size)
    singles = [chr(i) for i in range(clear)] + ["", ""]
    out: list[str] = []
    at, fresh = 0, True
    table, last = singles[:], ""
    put, add = out.append, table.append
    while at < total:
        if fresh:
            places, wide = at + before[:-1], widths
            room = int(np.searchsorted(places + wide, total, side="right"))
        else:  # the table is full and no clear code has come
            room = min(4096, (total - at) // MAX_BITS)
            places = at + MAX_BITS * np.arange(room)
            wide = np.full(room, MAX_BITS)
        if not room:
            break
        places, wide = places[:room], wide[:room]
        byte = places >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (places & 7).astype(np.uint32)) & ((1 << wide) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else room
        run = codes[:n].tolist()
        if not last and run:
            if run[0] >= clear:
                raise ValueError("a code stands before its string")
            last = table[run[0]]
            put(last)
            del run[0]
        room = full - len(table)
        for code in run[:room]:
            try:
                found = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("a code stands before its string") from None
                found = last + last[0]
            add(last + found[0])
            put(found)
            last = found
        for code in run[room:]:  # the table is full
            last = table[code]
            put(last)
        if len(stops):
            at = int(places[n] + wide[n])
            if codes[n] == end:
                break
            table, last, fresh = singles[:], "", True
            add = table.append
        else:
            at = int(places[-1] + wide[-1])
            if len(table) < full:
                break
            fresh = False
    return "".join(out).encode("latin-1")


def _blocks(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), 255):
        part = data[at : at + 255]
        yield bytes((len(part),)) + part
    yield b"\0"


def encode_gif(samples: bytes, width: int, palette: bytes = GREY, rows: int = FRAME_ROWS, delay: int = FRAME_DELAY) -> bytes:
    """A GIF89a of 8-bit samples in rows of ``width``, cut into timed frames of at most ``rows`` rows."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill rows")
    step = width * rows
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for at in range(0, len(samples), step):
        part = samples[at : at + step]
        out += [b"\x21\xf9\x04\x04", struct.pack("<HB", delay, 0), b"\0\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", *_blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """One image. ``indices`` are its own samples; ``rgb`` is the composed canvas, where ``shown`` marks drawn pixels."""

    delay_ms: int
    left: int
    top: int
    indices: np.ndarray
    rgb: np.ndarray
    shown: np.ndarray


def _deinterlaced(pixels: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(pixels), 0
    for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        n = len(range(first, len(pixels), step))
        out[first::step] = pixels[at : at + n]
        at += n
    return out


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames in order. Raises ValueError on what isn't a GIF or ends early."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    palette = None
    if packed & 0x80:
        n = 3 << (packed & 7) + 1
        palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    rgb, shown = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
    delay, clear_index, disposal = 0, None, 0

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    try:
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = joined(at + 2)
                if label == 0xF9:
                    flags, hundredths, index = struct.unpack_from("<BHB", body)
                    delay, disposal, clear_index = hundredths * 10, flags >> 2 & 7, index if flags & 1 else None
            elif data[at] == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                colours = palette
                if flags & 0x80:
                    n = 3 << (flags & 7) + 1
                    colours, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
                size = data[at]
                body, at = joined(at + 1)
                samples = np.frombuffer(lzw_decode(body, size), np.uint8)
                if colours is None or len(samples) < w * h or left + w > width or top + h > height:
                    raise ValueError("damaged image")
                pixels = samples[: w * h].reshape(h, w)
                pixels = _deinterlaced(pixels) if flags & 0x40 else pixels
                area = slice(top, top + h), slice(left, left + w)
                before = (rgb.copy(), shown.copy()) if disposal == 3 else None
                drawn = np.ones((h, w), bool) if clear_index is None else pixels != clear_index
                if drawn.any() and int(pixels[drawn].max()) >= len(colours):
                    raise ValueError("a colour beyond the palette")
                rgb[area][drawn] = colours[np.minimum(pixels, len(colours) - 1)][drawn]
                shown[area] |= drawn
                yield Frame(delay, left, top, pixels, rgb.copy(), shown.copy())
                if disposal == 2:
                    rgb[area], shown[area] = 0, False
                elif before:
                    rgb, shown = before
                delay, clear_index, disposal = 0, None, 0
            else:
                raise ValueError("damaged file")
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def colour_histogram(frame: Frame, bins: int = 16) -> np.ndarray:
    """Counts of drawn pixels: ``bins`` for each of red, green and blue, in a row."""
    pixels = frame.rgb.reshape(-1, 3) if frame.shown.all() else frame.rgb[frame.shown]
    return np.concatenate([np.bincount(pixels[:, c] // (256 // bins), minlength=bins) for c in range(3)])


FRAME_COLUMNS = "frame int, delay_ms int, width int, height int, pixels binary, histogram array<long>, error string"


def media_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, frame, delay_ms, width, height, pixels, histogram, error): a row per frame.

    ``pixels`` is the composed RGB canvas. A null gives no row; what can't be read gives one
    row with the reason in ``error`` after the frames before the damage. Ids may be null or
    repeated; other columns aren't read; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = pa.schema([("doc_id", batch.schema.field(0).type), ("frame", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
            for key, blob in zip(batch.column(0), batch.column(1), strict=True):
                if (blob := blob.as_py()) is None:
                    continue
                n = 0
                try:
                    for n, f in enumerate(decode_gif(blob), 1):
                        row = [[key.as_py()], [n - 1], [f.delay_ms], [f.rgb.shape[1]], [f.rgb.shape[0]], [f.rgb.tobytes()], [colour_histogram(f).tolist()], [None]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kind.types, strict=True)], schema=kind)
                except ValueError as e:
                    row = [[key.as_py()], [n], [None], [None], [None], [None], [None], [str(e)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kind.types, strict=True)], schema=kind)

    key = docs_type(media, id_col)
    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col)).mapInArrow(run, f"doc_id {key}, {FRAME_COLUMNS}")


def docs_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def store_texts(docs: DataFrame, width: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text's UTF-8, padded by blanks to full rows, as a GIF.

    A null text counts as empty; an empty one is a row of blanks. Equal texts give equal files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(t.as_py() or "").encode("utf-8", "replace") for t in part.column(1)]
                media = [encode_gif(b + b" " * (max(1, -(-len(b) // width)) * width - len(b)), width) for b in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {docs_type(docs, id_col)}, n_bytes long, media binary")


TIMED = pa.list_(pa.struct([("frame", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))


def media_digests(stored: DataFrame) -> DataFrame:
    """Reads every stored GIF back: digests of its samples and file, its histogram as text, and its timed frames.

    ``frames`` holds (frame, delay_ms, width, height, histogram) of every frame, the last as
    ``colour_histogram`` counts it. Null files, damaged ones and repeated ids don't come from ``store_texts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms", "frames"]
        for batch in batches:
            rows: list[list] = [[] for _ in names[2:]]
            for blob in batch.column(2):
                blob = blob.as_py()
                digest, size, tail, histogram, frames, ms, timed = hashlib.sha256(), 0, b"", 0, 0, 0, []
                for f in decode_gif(blob):
                    red = f.rgb[: f.indices.shape[0], :, 0].tobytes()  # the palette is grey: red is the sample
                    digest.update(red)
                    size, tail, frames, ms = size + len(red), red[-16:], frames + 1, ms + f.delay_ms
                    colours = colour_histogram(f)
                    timed.append({"frame": frames - 1, "delay_ms": f.delay_ms, "width": f.rgb.shape[1], "height": f.rgb.shape[0], "histogram": colours})
                    histogram = histogram + colours[:16]
                feature = f"frames={frames};grey16=" + ",".join(map(str, np.asarray(histogram).tolist()))
                for column, x in zip(rows, (size, digest.hexdigest(), zlib.crc32(tail), len(blob), hashlib.sha256(blob).hexdigest(), feature, frames, ms, timed), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), TIMED]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {docs_type(stored, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long, frames array<struct<frame:int,delay_ms:int,width:int,height:int,histogram:array<long>>>")


def op6_gif(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return media_digests(store_texts(table(spark, sf_dir, "documents")))
