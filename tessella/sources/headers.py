"""What the first bytes of pictures and H.264 streams say, read without decoding them.

These are narrow readers of published formats, for maps over files; nothing is
trusted, and what is cut off or contradicts itself is named.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds of a picture that may be decoded; profiles whose parameter sets
# have chroma fields; the tag of a picture's orientation.
LEAST_SIDE, MOST_SIDE, MOST_PIXELS = 32, 12_000, 24_000_000
CHROMA_PROFILES = (44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244)
WIDTH_TAG, HEIGHT_TAG, ORIENTATION_TAG = 256, 257, 274
#: More of these in one parameter set are no picture.
MOST_CODE_BITS, MOST_CYCLE = 32, 255


class Damaged(ValueError):
    """A header that is cut off or says what can't be."""


class Bits:
    """Bits of a byte string from the front, and the codes of variable length in it."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int = 1) -> int:
        if n > self.left:
            raise Damaged("CUT_OFF")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def unsigned(self) -> int:
        """An Exp-Golomb code: as many zeros as bits follow the next one."""
        zeros = 0
        while not self.take():
            zeros += 1
            if zeros > MOST_CODE_BITS:
                raise Damaged("CODE_TOO_LONG")
        return (1 << zeros) - 1 + self.take(zeros)

    def signed(self) -> int:
        code = self.unsigned()
        return (code + 1) // 2 if code % 2 else -(code // 2)


def _skip_scaling(bits: Bits, size: int) -> None:
    last = scale = 8
    for _ in range(size):
        if scale:
            scale = (last + bits.signed()) % 256
        last = scale or last


def sequence_parameters(unit: bytes) -> dict:
    """profile, level, width, height of a sequence parameter set, a NAL unit with its header byte; sizes after cropping."""
    if not unit or unit[0] & 0x1F != 7:
        raise Damaged("NO_SEQUENCE_PARAMETERS")
    bits = Bits(unit[1:].replace(b"\0\0\3", b"\0\0"))
    profile, _, level = bits.take(8), bits.take(8), bits.take(8)
    bits.unsigned()
    chroma = 1
    if profile in CHROMA_PROFILES:
        chroma = bits.unsigned()
        if chroma > 3:
            raise Damaged("CHROMA")
        separate = bits.take() if chroma == 3 else 0
        bits.unsigned(), bits.unsigned(), bits.take()
        if bits.take():
            for i in range(12 if chroma == 3 else 8):
                if bits.take():
                    _skip_scaling(bits, 16 if i < 6 else 64)
        chroma = 0 if separate else chroma
    bits.unsigned()
    order = bits.unsigned()
    if order == 0:
        bits.unsigned()
    elif order == 1:
        bits.take(), bits.signed(), bits.signed()
        cycle = bits.unsigned()
        if cycle > MOST_CYCLE:
            raise Damaged("REFERENCE_CYCLE")
        for _ in range(cycle):
            bits.signed()
    elif order > 2:
        raise Damaged("PICTURE_ORDER")
    bits.unsigned(), bits.take()
    width, height = bits.unsigned() + 1, bits.unsigned() + 1
    whole = bits.take()
    if not whole:
        bits.take()
    bits.take()
    across, down = (2 if chroma in (1, 2) else 1), (2 if chroma == 1 else 1) * (2 - whole)
    left = right = top = bottom = 0
    if bits.take():
        left, right, top, bottom = (bits.unsigned() for _ in range(4))
    width, height = 16 * width - across * (left + right), 16 * height * (2 - whole) - down * (top + bottom)
    if width <= 0 or height <= 0:
        raise Damaged("CROPPED_AWAY")
    return {"profile": profile, "level": level, "width": width, "height": height}


def decoder_configuration(data: bytes) -> dict:
    """What an avcC box says: profile, level, nal_length, n_sequence, n_picture, and the first set's width and height.

    ``problem`` names what is wrong: CUT_OFF, VERSION, PROFILE_DIFFERS, or what
    ``sequence_parameters`` finds; null if nothing.
    """
    out = dict.fromkeys(("profile", "level", "nal_length", "n_sequence", "n_picture", "avc_width", "avc_height", "problem"))
    try:
        if len(data) < 7:
            raise Damaged("CUT_OFF")
        if data[0] != 1:
            raise Damaged("VERSION")
        out |= {"profile": data[1], "level": data[3], "nal_length": (data[4] & 3) + 1}
        at = 5
        for name, mask in (("n_sequence", 0x1F), ("n_picture", 0xFF)):
            if at >= len(data):
                raise Damaged("CUT_OFF")
            units, n, at = [], data[at] & mask, at + 1
            for _ in range(n):
                size = int.from_bytes(data[at : at + 2], "big")
                if at + 2 + size > len(data) or not size:
                    raise Damaged("CUT_OFF")
                units.append(bytes(data[at + 2 : at + 2 + size]))
                at += 2 + size
            out[name] = n
            if name == "n_sequence" and units:
                found = sequence_parameters(units[0])
                out |= {"avc_width": found["width"], "avc_height": found["height"]}
                if (found["profile"], found["level"]) != (out["profile"], out["level"]):
                    raise Damaged("PROFILE_DIFFERS")
        if not out["n_sequence"] or not out["n_picture"]:
            raise Damaged("NO_PARAMETERS")
    except Damaged as e:
        out["problem"] = str(e)
    return out


def tiff_tags(data: bytes) -> dict[int, int]:
    """Whole numbers in the first directory of a TIFF, by tag; none if it is damaged."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    number = lambda at, n: int.from_bytes(data[at : at + n], order)
    if order is None or number(2, 2) != 42:
        return {}
    start = number(4, 4)
    n = number(start, 2) if start + 2 <= len(data) else 0
    out = {}
    for at in range(start + 2, start + 2 + 12 * n, 12):
        kind = number(at + 2, 2)
        if at + 12 <= len(data) and kind in (3, 4) and number(at + 4, 4) == 1:
            out[number(at, 2)] = number(at + 8, 2 if kind == 3 else 4)
    return out


def _jpeg(data: bytes) -> tuple[int, int, int]:
    at, orientation = 2, 1
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            orientation = tiff_tags(body[6:]).get(ORIENTATION_TAG, 1)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if len(body) < 5:
                break
            return int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), orientation
        if size < 2 or marker == 0xDA:
            break
        at += 2 + size
    raise Damaged("DAMAGED")


def _webp(data: bytes) -> tuple[int, int, int]:
    at, found, orientation = 12, None, 1
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if kind == b"VP8X" and len(body) >= 10:
            found = int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        elif kind == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
            packed = int.from_bytes(body[1:5], "little")
            found = found or ((packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1)
        elif kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
            found = found or (int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF)
        elif kind == b"EXIF":
            orientation = tiff_tags(body.removeprefix(b"Exif\0\0")).get(ORIENTATION_TAG, 1)
        at += 8 + size + size % 2
    if found is None:
        raise Damaged("DAMAGED")
    return (*found, orientation)


def picture_header(data: bytes | None) -> dict:
    """media_type, width, height (as stored), orientation (1 to 8) and problem of a picture, from its header alone.

    UNSUPPORTED and DAMAGED have no sizes; TOO_SMALL, TOO_LARGE and
    TOO_MANY_PIXELS say that it isn't to be decoded.
    """
    out = dict.fromkeys(("media_type", "width", "height", "orientation", "problem"))
    data = data or b""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            out["media_type"] = "image/png"
            if data[12:16] != b"IHDR" or len(data) < 24:
                raise Damaged("DAMAGED")
            found = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), 1
        elif data[:2] == b"\xff\xd8":
            out["media_type"] = "image/jpeg"
            found = _jpeg(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            out["media_type"] = "image/webp"
            found = _webp(data)
        elif data[:4] in (b"II*\0", b"MM\0*"):
            out["media_type"] = "image/tiff"
            tags = tiff_tags(data)
            if not {WIDTH_TAG, HEIGHT_TAG} <= set(tags):
                raise Damaged("DAMAGED")
            found = tags[WIDTH_TAG], tags[HEIGHT_TAG], tags.get(ORIENTATION_TAG, 1)
        else:
            raise Damaged("UNSUPPORTED")
        width, height, orientation = found
        out |= {"width": width, "height": height, "orientation": orientation if 1 <= orientation <= 8 else 1}
        if min(width, height) < LEAST_SIDE:
            raise Damaged("TOO_SMALL")
        if max(width, height) > MOST_SIDE:
            raise Damaged("TOO_LARGE")
        if width * height > MOST_PIXELS:
            raise Damaged("TOO_MANY_PIXELS")
    except Damaged as e:
        out["problem"] = str(e)
    return out


HEADER = "media_type string, width bigint, height bigint, orientation int, problem string"


def header_of(content: Column) -> Column:
    """A struct of what ``picture_header`` says."""
    kind = pa.struct([("media_type", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("orientation", pa.int32()), ("problem", pa.string())])

    def run(column: pa.Array) -> pa.Array:
        return pa.array([picture_header(x) for x in column.to_pylist()], kind)

    return F.arrow_udf(run, f"struct<{HEADER.replace(' ', ':').replace(',:', ',')}>")(content)


def picture_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, media_type, width, height, orientation, problem) of the files in a folder, none of them decoded."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), header_of(F.col("content")).alias("h")).select("file", "h.*")


def turned(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """A picture, height by width by channels, as it is to be seen: one of eight turns and mirrorings."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def upright(data: Column, width: Column, height: Column, channels: Column, orientation: Column) -> Column:
    """A struct of data, width, height: decoded pixels turned as their header says; null where they don't fit the sizes."""
    kind = pa.struct([("data", pa.binary()), ("width", pa.int32()), ("height", pa.int32())])

    def run(*columns: pa.Array) -> pa.Array:
        def one(data, width, height, channels, orientation) -> dict | None:
            if not data or not width or not height or not channels or len(data) != width * height * channels:
                return None
            seen = turned(np.frombuffer(data, np.uint8).reshape(height, width, channels), orientation)
            return {"data": seen.tobytes(), "width": seen.shape[1], "height": seen.shape[0]}

        return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    return F.arrow_udf(run, "struct<data:binary,width:int,height:int>")(data, width, height, channels, orientation)
