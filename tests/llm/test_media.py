import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import media
from tessella.llm.media import add_png, cosine_hash, decode_png, encode_png, pad_payload, read_png, unfilter


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = pad_payload(data)
    assert len(payload) % 576 == 0 and payload[: len(data)] == data and len(payload) >= 576
    assert decode_png(encode_png(np.frombuffer(payload, np.uint8).reshape(-1, 576))).tobytes() == payload


def filtered(pixels, kinds):
    """A second, slow writing of the five row filters."""
    out = []
    for y, row in enumerate(pixels.tolist()):
        above = pixels[y - 1].tolist() if y else [0] * len(row)
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            paeth = min([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)])[2]
            line.append((v - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


def test_all_row_filters_are_undone():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (40, 33), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    assert (unfilter(kinds, filtered(pixels, kinds)) == pixels).all()


def test_damage_is_found():
    good = encode_png(np.full((3, 576), 7, np.uint8))
    for at in range(8, len(good), 3):
        bad = bytearray(good)
        bad[at] ^= 0x10
        with pytest.raises((ValueError, zlib.error)):
            decode_png(bytes(bad))


def test_hash_is_that_of_a_plain_cosine_transform():
    pixels = np.random.default_rng(2).integers(0, 256, (64, 576)).astype(np.uint8)
    small = pixels.astype(float).reshape(32, 2, 32, 18).mean(axis=(1, 3))
    low = [
        sum(small[y, x] * np.cos(np.pi * k * (2 * y + 1) / 64) * np.cos(np.pi * m * (2 * x + 1) / 64) for y in range(32) for x in range(32))
        for k in range(8)
        for m in range(8)
    ]
    bits = "".join("1" if v > np.median(low[1:]) else "0" for v in low)
    assert cosine_hash(pixels) == f"{int(bits, 2):016x}"


def test_column_round_trip(hard, clashing, empty):
    for frame in (hard, clashing):
        rows = read_png(add_png(frame)).select("text", "media", "decoded.*").collect()
        for r in rows:
            payload = media.pad_payload((r.text or "").encode())
            assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert r.tail_crc32 == zlib.crc32(payload[-32:]) and len(r.feature) == 16
        assert len({(r.text, bytes(r.media), r.feature) for r in rows}) == len({r.text for r in rows})
    assert read_png(add_png(empty)).count() == 0
