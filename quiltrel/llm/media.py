"""Media columns: Netpbm and BMP bytes decoded to arrays, area-resized, tiled, hashed.

Rows are handled one at a time inside Arrow batches: one scan, no shuffle. A null payload is the
empty one. Extra columns are ignored; repeated rows give repeated results; an image of any
height decodes (integral images are 64-bit).
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltrel.llm.common import text_or_empty

ROW = 192  # bytes of an image row: 64 pixels of three samples
TILE = 16  # side of the NPY tile


def encode_ppm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP: rows bottom up, blue first, each row padded to four bytes."""
    h, w = pixels.shape[:2]
    pad = -3 * w % 4
    rows = np.zeros((h, 3 * w + pad), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    body = rows.tobytes()
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


_NUMBER = re.compile(rb"(?:[ \t\r\n]|#[^\n]*\n)*([0-9]+)")


def decode(media: bytes) -> np.ndarray:
    """P1-P6 of Netpbm or an uncompressed 24-bit BMP -> (h, w) or (h, w, 3) of uint8."""
    if media[:2] == b"BM":
        start, width, height = struct.unpack_from("<I", media, 10)[0], *struct.unpack_from("<ii", media, 18)
        bits, packed = struct.unpack_from("<HI", media, 28)
        if bits != 24 or packed:
            raise ValueError(f"BMP of {bits} bits, compression {packed}")
        line = 3 * width + -3 * width % 4
        rows = np.frombuffer(media, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : 3 * width]
        rows = rows.reshape(abs(height), width, 3)[:, :, ::-1]
        return rows[::-1] if height > 0 else rows
    kind, at, head = media[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("neither Netpbm nor BMP")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _NUMBER.match(media, at)):
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head[0], head[1], head[2] if len(head) > 2 else 1
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    size = int(np.prod(shape))
    if kind in (b"P5", b"P6"):
        if top > 255:
            wide = np.frombuffer(media, ">u2", size, at + 1).astype(np.int64)
            return (wide * 255 // top).astype(np.uint8).reshape(shape)
        flat = np.frombuffer(media, np.uint8, size, at + 1)
    elif kind == b"P4":
        line = (w + 7) // 8
        packed = np.frombuffer(media, np.uint8, line * h, at + 1).reshape(h, line)
        return (1 - np.unpackbits(packed, axis=1)[:, :w]) * np.uint8(255)
    elif kind == b"P1":
        flat = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", media[at:])), np.uint8)[:size]
        return ((49 - flat) * np.uint8(255)).reshape(shape)
    else:
        flat = np.array(re.sub(rb"#[^\n]*", b"", media[at:]).split()[:size], np.int64)
    return (flat if top == 255 else (flat.astype(np.int64) * 255 // top).astype(np.uint8)).reshape(shape).astype(np.uint8)


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell, edges weighted by the area covered: the integral image,
    read between its grid points by linear interpolation, gives every cell's exact sum."""
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1), np.float64)
    total[1:, 1:] = gray.astype(np.int64).cumsum(0).cumsum(1)
    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    y0, x0 = np.minimum(ys.astype(np.int64), h - 1), np.minimum(xs.astype(np.int64), w - 1)
    fy, fx = (ys - y0)[:, None], xs - x0
    rows = total[y0] * (1 - fy) + total[y0 + 1] * fy
    grid = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    cells = np.diff(np.diff(grid, axis=0), axis=1)
    return cells * (height * width / (h * w))


def gray_of(pixels: np.ndarray) -> np.ndarray:
    if pixels.ndim == 2:
        return pixels
    p = pixels.astype(np.int64)
    return (299 * p[:, :, 0] + 587 * p[:, :, 1] + 114 * p[:, :, 2] + 500) // 1000


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def difference_hash(gray: np.ndarray) -> str:
    """64 bits, as 16 hex digits: is a cell of the 8 x 9 reduction darker than its right neighbour?"""
    small = np.rint(area_resize(gray, 8, 9) * 16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def features(media: bytes) -> tuple[np.ndarray, str, bytes]:
    """(decoded array, difference hash, NPY tile) of stored media bytes."""
    pixels = decode(media)
    gray = gray_of(pixels)
    tile = np.rint(area_resize(gray, TILE, TILE)).astype(np.uint8)
    return pixels, difference_hash(gray), npy(tile)


def store(payload: bytes, codec: str = "ppm") -> bytes:
    """Bytes of a length that is a multiple of 192, as the pixels of an image 64 wide."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return encode_bmp(pixels) if codec == "bmp" else encode_ppm(pixels)


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string, media binary, tile binary, height long"
)


def text_media(docs: DataFrame, *, codec: str = "ppm", with_media: bool = True) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA: each text's bytes stored as an image, read back from the
    stored bytes, with its NPY tile. with_media=False leaves the stored bytes out of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                out = []
                for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    payload = raw + b" " * (-len(raw) % ROW or ROW * (not raw))
                    media = store(payload, codec)
                    pixels, mark, tile = features(media)
                    back = pixels.tobytes()
                    out.append(
                        (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
                         hashlib.sha256(media).hexdigest(), mark, media if with_media else None, tile, pixels.shape[0])
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES
                )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("raw")).mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(",")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(",")]


def digest(media: DataFrame) -> DataFrame:
    return media.select(*_NAMES[:8], "height", F.length("tile").cast("long").alias("tile_bytes"), F.sha2("tile", 256).alias("tile_sha256"))
