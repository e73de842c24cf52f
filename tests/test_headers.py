import random
import struct
import time

import numpy as np
import pytest

from tessella.operators.frames import KeptHashes
from tessella.sources import files, headers


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n=1):
        self.bits += f"{value:0{n}b}"[-n:] if n else ""
        return self

    def ue(self, value):
        code = f"{value + 1:b}"
        self.bits += "0" * (len(code) - 1) + code
        return self

    def se(self, value):
        return self.ue(2 * value - 1 if value > 0 else -2 * value)

    def bytes(self):
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        out = b""
        for b in raw:  # emulation prevention
            out += b"\3" if out[-2:] == b"\0\0" and b <= 3 else b""
            out += bytes([b])
        return out


def sps(width, height, profile=77, level=31, whole=1, crop=(0, 0, 0, 0), chroma=1, order=0, scaling=False):
    w = Writer().put(profile, 8).put(0, 8).put(level, 8).ue(0)
    if profile == 100:
        w.ue(chroma)
        if chroma == 3:
            w.put(0)
        w.ue(0).ue(0).put(0).put(int(scaling))
        if scaling:
            for i in range(12 if chroma == 3 else 8):
                w.put(int(i % 2 == 0))
                if i % 2 == 0:
                    for k in range(16 if i < 6 else 64):
                        w.se(1 if k % 3 else -1)
    w.ue(4).ue(order)
    if order == 0:
        w.ue(2)
    elif order == 1:
        w.put(0).se(-3).se(4).ue(2).se(1).se(-1)
    w.ue(4).put(0).ue(width // 16 - 1).ue(height // 16 // (2 - whole) - 1).put(whole)
    if not whole:
        w.put(1)
    w.put(1).put(int(any(crop)))
    if any(crop):
        for c in crop:
            w.ue(c)
    return b"\x67" + w.put(0).bytes()


def avcc(units, pictures=(b"\x68\xee",), profile=77, level=31):
    out = bytes([1, profile, 0, level, 0xFF, 0xE0 | len(units)])
    out += b"".join(struct.pack(">H", len(u)) + u for u in units)
    return out + bytes([len(pictures)]) + b"".join(struct.pack(">H", len(u)) + u for u in pictures)


@pytest.mark.parametrize("order", [0, 1, 2])
@pytest.mark.parametrize("profile, chroma, scaling", [(77, 1, False), (100, 1, True), (100, 2, False), (100, 3, True), (100, 0, False)])
def test_parameter_sets(profile, chroma, scaling, order):
    across, down = {0: (1, 1), 1: (2, 2), 2: (2, 1), 3: (1, 1)}[chroma]
    for whole, crop in ((1, (0, 0, 0, 0)), (1, (1, 2, 0, 4)), (0, (0, 0, 0, 2))):
        unit = sps(1920, 1088, profile, 31, whole, crop, chroma, order, scaling)
        got = headers.sequence_parameters(unit)
        want = 1920 - across * (crop[0] + crop[1]), 1088 - down * (2 - whole) * (crop[2] + crop[3])
        assert (got["profile"], got["level"], got["width"], got["height"]) == (profile, 31, *want)
        whole_box = headers.decoder_configuration(avcc([unit], profile=profile))
        assert (whole_box["avc_width"], whole_box["avc_height"], whole_box["nal_length"], whole_box["problem"]) == (*want, 4, None)


def test_damaged_parameter_sets_are_named():
    unit = sps(640, 480)
    assert headers.decoder_configuration(b"")["problem"] == "CUT_OFF"
    assert headers.decoder_configuration(b"\2" + avcc([unit])[1:])["problem"] == "VERSION"
    assert headers.decoder_configuration(avcc([unit], level=40))["problem"] == "PROFILE_DIFFERS"
    assert headers.decoder_configuration(avcc([]))["problem"] == "NO_PARAMETERS"
    assert headers.decoder_configuration(avcc([b"\x68" + unit[1:]]))["problem"] == "NO_SEQUENCE_PARAMETERS"
    assert headers.decoder_configuration(avcc([b"\x67\x4d\0\x1f" + bytes(20)]))["problem"] in ("CODE_TOO_LONG", "CUT_OFF")
    assert headers.decoder_configuration(avcc([sps(16, 16, crop=(4, 4, 0, 0))]))["problem"] == "CROPPED_AWAY"
    whole = avcc([unit])
    assert all(headers.decoder_configuration(whole[:n])["problem"] for n in range(len(whole)))
    rng = random.Random(1)
    for _ in range(300):
        headers.decoder_configuration(bytes(rng.randrange(256) for _ in range(rng.randrange(60))))


def exif(orientation, order="<"):
    head = b"II*\0" if order == "<" else b"MM\0*"
    return head + struct.pack(order + "I", 8) + struct.pack(order + "H", 1) + struct.pack(order + "HHIHH", 274, 3, 1, orientation, 0) + bytes(4)


def jpeg(width, height, orientation=None, order="<"):
    app = b"" if orientation is None else b"Exif\0\0" + exif(orientation, order)
    head = b"" if orientation is None else b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app
    return b"\xff\xd8\xff\xe0\0\4ab" + head + b"\xff\xff\xc0\0\x0b\x08" + struct.pack(">HH", height, width) + b"\1\1\x11\0"


def png(width, height):
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", width, height)


def webp(kind, body):
    return b"RIFF" + bytes(4) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def test_picture_headers():
    read = lambda data: tuple(headers.picture_header(data).values())
    for o in range(1, 9):
        for order in "<>":
            assert read(jpeg(300, 200, o, order)) == ("image/jpeg", 300, 200, o, None)
    assert read(jpeg(300, 200)) == ("image/jpeg", 300, 200, 1, None) and read(jpeg(300, 200, 77))[3] == 1
    assert read(png(40, 50)) == ("image/png", 40, 50, 1, None)
    assert read(webp(b"VP8X", bytes(4) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))) == ("image/webp", 100, 50, 1, None)
    assert read(webp(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little"))) == ("image/webp", 100, 50, 1, None)
    assert read(webp(b"VP8 ", b"abc\x9d\x01\x2a" + struct.pack("<HH", 100, 50))) == ("image/webp", 100, 50, 1, None)
    tiff = b"II*\0" + struct.pack("<IH", 8, 3) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in ((256, 64), (257, 48), (274, 6)))
    assert read(tiff) == ("image/tiff", 64, 48, 6, None)
    assert read(png(31, 50))[4] == "TOO_SMALL" and read(png(12_001, 50))[4] == "TOO_LARGE" and read(png(11_000, 11_000))[4] == "TOO_MANY_PIXELS"
    assert read(b"GIF89a")[4] == "UNSUPPORTED" == read(None)[4] and read(png(9, 9)[:20])[4] == "DAMAGED" == read(jpeg(9, 9)[:12])[4]
    for data in (jpeg(300, 200, 6), webp(b"VP8X", bytes(10)), tiff):
        for n in range(len(data)):
            headers.picture_header(data[:n])


def test_eight_orientations():
    seen = np.arange(6).reshape(2, 3, 1)
    # How a picture is stored that is to be seen as ``seen``, by the published meaning of row 0 and column 0.
    stored = {1: seen, 2: seen[:, ::-1], 3: seen[::-1, ::-1], 4: seen[::-1], 5: seen.swapaxes(0, 1), 6: np.rot90(seen), 7: np.rot90(seen[::-1]), 8: np.rot90(seen, -1)}
    for orientation, pixels in stored.items():
        assert headers.turned(pixels, orientation).tolist() == seen.tolist(), orientation


def test_tracks_and_headers_from_files(spark, tmp_path):
    box = lambda kind, body=b"": (len(body) + 8).to_bytes(4, "big") + kind + body
    n = lambda *values: b"".join(v.to_bytes(4, "big") for v in values)
    entry = bytes(24) + struct.pack(">HH", 640, 480) + bytes(50) + box(b"avcC", avcc([sps(640, 480)]))
    stbl = box(b"stbl", box(b"stsd", n(0, 1, len(entry) + 8) + b"avc1" + entry) + box(b"stts", n(0, 1, 15, 100)) + box(b"stsz", n(0, 0, 15)) + box(b"stss", n(0, 2, 1, 9)))
    mdia = box(b"mdia", box(b"mdhd", n(0, 0, 0, 1000, 1500, 0)) + box(b"hdlr", n(0, 0) + b"vide" + bytes(13)) + box(b"minf", stbl))
    (tmp_path / "m.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"tkhd", bytes(76) + n(640 << 16, 480 << 16)) + mdia)))
    r = files.movie_tracks(spark, str(tmp_path / "m.mp4")).first()
    assert (r.coded_width, r.coded_height, r.sized_samples, r.sync_samples, r.first_sync) == (640, 480, 15, 2, 1)
    assert (r.profile, r.level, r.nal_length, r.n_sequence, r.n_picture, r.avc_width, r.avc_height, r.problem, r.agrees) == (77, 31, 4, 1, 1, 640, 480, None, True)
    (tmp_path / "pictures").mkdir()
    (tmp_path / "pictures" / "a.jpg").write_bytes(jpeg(300, 200, 6))
    (tmp_path / "pictures" / "bomb.png").write_bytes(png(11_000, 11_000))
    got = {r.file.rsplit("/", 1)[1]: (r.orientation, r.problem) for r in headers.picture_headers(spark, str(tmp_path / "pictures")).collect()}
    assert got == {"a.jpg": (6, None), "bomb.png": (1, "TOO_MANY_PIXELS")}


@pytest.mark.parametrize("near", [0, 1, 4, 63, 64])
def test_kept_hashes_equal_a_scan(near):
    rng = random.Random(near)
    kept, plain, base = KeptHashes(near), [], [rng.getrandbits(64) for _ in range(5)]
    for _ in range(300):
        own = rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8)))
        want = min((((h ^ own).bit_count(), i) for i, h in enumerate(plain)), default=None)
        assert kept.nearest(own) == (want if want and want[0] <= near else None)
        kept.add(own)
        plain.append(own)


def test_many_kept_hashes_take_linear_time():
    rng, kept = random.Random(3), KeptHashes(4)
    began = time.perf_counter()
    for _ in range(200_000):
        own = rng.getrandbits(64)
        if not kept.nearest(own):
            kept.add(own)
    assert len(kept.hashes) > 199_000 and time.perf_counter() - began < 120
