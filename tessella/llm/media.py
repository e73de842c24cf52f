"""Media columns: 8-bit grey PNGs in binary columns, with a cosine-transform hash.

The encoder writes the signature and the IHDR, IDAT and IEND chunks with their
CRC-32, filters each row by the smallest sum of absolute residuals, and deflates
the rows with zlib. The decoder tests every checksum and undoes any of the five
row filters with numpy. The hash compares the 64 lowest cosine coefficients of
the picture, averaged to 32 x 32, with their median.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bytes_udf

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, BITS = 0, 8

WIDTH = 576
PAD = 255
#: Rows of a picture that are filtered at a time, whatever its height.
ROWS = 1024
GRID, LOW = 32, 8
RESULT = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string>"

_k, _x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
#: Rows of the type-II cosine transform for the lowest frequencies.
COSINES = np.cos(np.pi * _k * (2 * _x + 1) / (2 * GRID))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad_payload(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` and bytes 255, up to a positive multiple of ``width``."""
    return data + bytes([PAD]) * (-len(data) % width if data else width)


def _filter_rows(pixels: np.ndarray, before: np.ndarray) -> bytes:
    """Each row by the best of filters 0 to 2, with the filter's number; ``before`` is the row above the first."""
    height, width = pixels.shape
    left = np.zeros_like(pixels)
    left[:, 1:] = pixels[:, :-1]
    above = np.concatenate([before[None], pixels[:-1]])
    filtered = np.stack([pixels, pixels - left, pixels - above])
    weight = np.abs(filtered.view(np.int8).astype(np.int16)).sum(axis=2)
    best = weight.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = filtered[best, np.arange(height)]
    return rows.tobytes()


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """A grey PNG of a two-dimensional uint8 array, filtered and deflated ``ROWS`` rows at a time."""
    height, width = pixels.shape
    deflate = zlib.compressobj(level)
    parts = []
    for at in range(0, height, ROWS):
        before = pixels[at - 1] if at else np.zeros(width, np.uint8)
        parts.append(deflate.compress(_filter_rows(pixels[at : at + ROWS], before)))
    parts.append(deflate.flush())
    header = struct.pack(">IIBBBBB", width, height, BITS, GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", b"".join(parts)) + _chunk(b"IEND", b"")


def _paeth_row(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, a, c = row.astype(np.int32), 0, 0
    for i, b in enumerate(above.tolist()):
        p = a + b - c
        near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        a, c = (int(out[i]) + near) & 255, b
        out[i] = a
    return out.astype(np.uint8)


def _average_row(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, a = row.astype(np.int32), 0
    for i, b in enumerate(above.tolist()):
        a = (int(out[i]) + (a + b) // 2) & 255
        out[i] = a
    return out.astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters; all arithmetic is modulo 256."""
    out = rows.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    above = np.zeros(rows.shape[1], np.uint8)
    for y in np.flatnonzero(kinds >= 2).tolist():
        above = out[y - 1] if y else np.zeros(rows.shape[1], np.uint8)
        if kinds[y] == 2:
            out[y] += above
        elif kinds[y] == 3:
            out[y] = _average_row(rows[y], above)
        elif kinds[y] == 4:
            out[y] = _paeth_row(rows[y], above)
        else:
            raise ValueError(f"unknown PNG filter {kinds[y]}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey PNG that isn't interlaced; a damaged one raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, size = 8, [], None
    while True:
        if at + 12 > len(data):
            raise ValueError("PNG ends early")
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if len(data) < at + 12 + length or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError(f"PNG chunk {kind!r} has a wrong checksum")
        at += 12 + length
        if kind == b"IHDR":
            width, height, bits, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (bits, colour, rest) != (BITS, GREY, [0, 0, 0]):
                raise ValueError("only 8-bit grey PNGs without interlacing are read")
            size = height, width
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[0], size[1] + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _averaged(pixels: np.ndarray, cells: int) -> np.ndarray:
    """Mean of each of ``cells`` bands of rows; fewer rows than bands repeat."""
    edges = np.arange(cells + 1) * pixels.shape[0] // cells
    starts = edges[:-1]
    widths = np.maximum(edges[1:] - starts, 1)
    if pixels.shape[0] < cells:
        return pixels[starts]
    return np.add.reduceat(pixels, starts, axis=0, dtype=np.float64) / widths[:, None]


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the lowest 8 x 8 cosine coefficients exceed their median."""
    small = _averaged(_averaged(pixels, GRID).T, GRID).T
    low = (COSINES @ small @ COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def add_png(docs: DataFrame, text_col: str = "text", out_col: str = "media", width: int = WIDTH, level: int = 1) -> DataFrame:
    """``docs`` with the UTF-8 bytes of each whole text as a PNG in a binary column.

    Rows of ``width`` samples, padded with 255; null and empty texts become one
    row of padding. Equal texts give equal bytes.
    """

    def batch(texts: list[bytes]) -> pa.Array:
        return pa.array(
            [encode_png(np.frombuffer(pad_payload(t, width), np.uint8).reshape(-1, width), level) for t in texts],
            type=pa.binary(),
        )

    return docs.withColumn(out_col, bytes_udf(batch, "binary")(F.col(text_col)))


def read_png(media: DataFrame, media_col: str = "media", out_col: str = "decoded") -> DataFrame:
    """``media`` with digests of the decoded samples and the cosine hash.

    A null picture gives null; a picture with a wrong checksum stops the job.
    """

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for data in column.to_pylist():
            if data is None:
                rows.append(None)
                continue
            pixels = decode_png(data)
            raw = pixels.tobytes()
            rows.append(
                {
                    "payload_bytes": len(raw),
                    "payload_sha256": hashlib.sha256(raw).hexdigest(),
                    "tail_crc32": zlib.crc32(raw[-32:]),
                    "feature": cosine_hash(pixels),
                }
            )
        kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]
        return pa.array(rows, type=pa.struct(kinds))

    return media.withColumn(out_col, run.asNondeterministic()(F.col(media_col)))
