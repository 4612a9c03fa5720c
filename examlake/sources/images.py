"""Image files as rows of grey pages: PNG and the portable grey and colour maps, decoded with zlib and NumPy.

Files are read by Spark's own binary source, so from any store that Spark reaches, and split by file. A file that
cannot be read is a row with a reason, never an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewer bytes are no image.
LEAST_BYTES = 16
#: A header that asks for more pixels than this is taken for a broken one.
MOST_PIXELS = 400_000_000
_PNG = b"\x89PNG\r\n\x1a\n"


class Unreadable(ValueError):
    """Why an image can't be read."""


def _unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters; ``step`` bytes are a pixel.

    A byte depends on those a pixel to the left, above, and both, so all bytes of a diagonal are free at once: row r is a
    pixel behind row r - 1.
    """
    h, n = raw.shape[0], raw.shape[1] // step
    out = np.zeros((h + 1, (n + 1) * step), np.uint8)  # a row above and a pixel to the left of nothing
    if np.isin(kinds, (0, 2)).all():
        body = raw.copy()
        for r in np.flatnonzero(kinds == 2):
            body[r] += body[r - 1] if r else 0
        return body
    view, source = out.reshape(h + 1, n + 1, step), raw.reshape(h, n, step)
    for t in range(h + n - 1):
        r = np.arange(max(0, t - n + 1), min(h, t + 1))
        x = t - r
        a, b, c = view[r + 1, x].astype(np.int16), view[r, x + 1].astype(np.int16), view[r, x].astype(np.int16)
        p = a + b - c
        da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        near = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        kind = kinds[r][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) // 2, near], 0)
        view[r + 1, x + 1] = (source[r, x] + guess).astype(np.uint8)
    return out[1:, step:]


def decoded_png(raw: bytes) -> np.ndarray:
    """Samples as (height, width, channels), 8 bit; palettes are looked up, transparency is left out, 16 bit are cut to 8."""
    at, head, palette, packed = 8, None, None, []
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or len(raw) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise Unreadable("CORRUPT")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not packed:
        raise Unreadable("CORRUPT")
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlaced or (depth not in (8, 16) and channels > 1) or depth not in (1, 2, 4, 8, 16):
        raise Unreadable("UNSUPPORTED")
    if not 0 < w * h <= MOST_PIXELS:
        raise Unreadable("CORRUPT")
    line = (w * channels * depth + 7) // 8
    want = h * (line + 1)
    unpacked = zlib.decompressobj().decompress(b"".join(packed), want)
    if len(unpacked) != want:
        raise Unreadable("CORRUPT")
    rows = np.frombuffer(unpacked, np.uint8).reshape(h, line + 1)
    if rows[:, 0].max() > 4:
        raise Unreadable("CORRUPT")
    body = _unfiltered(rows[:, 1:], rows[:, 0], max(1, channels * depth // 8))
    if depth < 8:
        bits = np.unpackbits(body, axis=1).reshape(h, -1, depth)[:, :w]
        body = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        if colour == 0:
            body = body * (255 // ((1 << depth) - 1))
    elif depth == 16:
        body = body.reshape(h, -1, 2)[:, :, 0]
    if colour == 3:
        if palette is None or body.max(initial=0) >= len(palette):
            raise Unreadable("CORRUPT")
        return palette[body]
    out = body.reshape(h, w, channels)
    return out[:, :, :-1] if channels in (2, 4) else out


def decoded_map(raw: bytes) -> np.ndarray:
    """Portable grey (P2, P5) and colour (P3, P6) maps; comments in the header are passed over."""
    words, at = [], 2
    while len(words) < 3:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = (raw.find(b"\n", at) + 1) or len(raw)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        if not raw[at:end].isdigit():
            raise Unreadable("CORRUPT")
        words.append(int(raw[at:end]))
        at = end
    (w, h, top), channels = words, 3 if raw[1:2] in b"36" else 1
    n = w * h * channels
    if not 0 < w * h <= MOST_PIXELS or not 0 < top < 65536:
        raise Unreadable("CORRUPT")
    if raw[1:2] in b"23":
        values = raw[at:].split()[:n]
        if len(values) < n or not all(v.isdigit() for v in values):
            raise Unreadable("CORRUPT")
        samples = np.array(values, np.int64)
    else:
        width = 2 if top > 255 else 1
        body = raw[at + 1 : at + 1 + n * width]
        if len(body) < n * width:
            raise Unreadable("CORRUPT")
        samples = np.frombuffer(body, ">u2" if width == 2 else np.uint8).astype(np.int64)
    return (np.minimum(samples, top) * 255 // top).astype(np.uint8).reshape(h, w, channels)


def decoded(raw: bytes) -> np.ndarray:
    """Samples of an image; ``Unreadable`` tells why there are none."""
    if len(raw) < LEAST_BYTES:
        raise Unreadable("TOO_SMALL")
    try:
        if raw[:8] == _PNG:
            return decoded_png(raw)
        if raw[:1] == b"P" and raw[1:2] in b"2356":
            return decoded_map(raw)
    except (zlib.error, struct.error, ValueError) as e:
        raise e if isinstance(e, Unreadable) else Unreadable("CORRUPT") from e
    raise Unreadable("UNKNOWN_FORMAT")


def grey_of(samples: np.ndarray) -> np.ndarray:
    """Luma, rounded; grey samples as they are."""
    if samples.shape[2] == 1:
        return np.ascontiguousarray(samples[:, :, 0])
    return np.rint(samples @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def saturation(samples: np.ndarray) -> float:
    """Mean saturation of 0 to 255: how far the least sample lies below the greatest, against the greatest."""
    most, least = samples.max(2).astype(float), samples.min(2).astype(float)
    return float((255 * (most - least) / np.maximum(most, 1)).mean())


def decoded_images(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """``page_id``, ``width``, ``height``, ``pixels`` (grey, a byte a pixel), ``saturation`` and ``problem`` of each row's bytes.

    ``problem`` is null for a page; otherwise MISSING (null), TOO_SMALL, UNKNOWN_FORMAT, UNSUPPORTED (interlaced) or CORRUPT, and
    the other columns are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one image at a time
                raw, page, shade, problem = batch.column(1)[at].as_py(), None, None, None
                try:
                    if raw is None:
                        raise Unreadable("MISSING")
                    samples = decoded(raw)
                    page, shade = grey_of(samples), saturation(samples)
                except Unreadable as e:
                    problem = str(e)
                sides = (None, None) if page is None else page.shape[::-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([sides[0]], pa.int32()), pa.array([sides[1]], pa.int32()), pa.array([None if page is None else page.tobytes()], pa.binary()), pa.array([shade], pa.float64()), pa.array([problem], pa.string())], ["page_id", "width", "height", "pixels", "saturation", "problem"])

    kind = dict(files.dtypes)[id_col]
    return files.select(F.col(id_col).alias("page_id"), F.col(content)).mapInArrow(run, f"page_id {kind}, width int, height int, pixels binary, saturation double, problem string")


def image_files(spark: SparkSession, folder: str, pattern: str = "*.{png,pgm,ppm}") -> DataFrame:
    """The decoded images of a folder and those below it; ``page_id`` is the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return decoded_images(files.select("path", "content"))


def ordered_paths(spark: SparkSession, folder: str, pattern: str = "*.{png,pgm,ppm}") -> DataFrame:
    """``path`` and ``length`` of a folder's images in ascending order of path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length").orderBy("path")
