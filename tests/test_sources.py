import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources import codecs, images


@pytest.mark.parametrize("kind", codecs.FORMATS)
@pytest.mark.parametrize("channels", [1, 3])
def test_round_trip(kind, channels):
    _, decode, encode, most = codecs.FORMATS[kind]
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (5, 11, channels)) * 257.0
    if most == 1:
        a = np.where(a > 30000, 65535.0, 0.0)
    data = encode(a)
    back = decode(data)
    assert codecs.sniff(data) == kind and back.shape[:2] == (5, 11)
    want = a if back.shape[2] == channels else codecs._rgba(a) if back.shape[2] == 4 else codecs._rgb(a) if back.shape[2] == 3 else codecs._gray(a)
    if most == 1:
        want = np.where(want < 32767.5, 0.0, 65535.0)
    elif back.shape[2] == 1 and channels == 3:
        want = np.floor(want / 65535 * (most or 65535) + 0.5) / (most or 65535) * 65535
    assert np.allclose(back, want, atol=1e-2)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    raw, above = b"", np.zeros(12 + 3, int)
    for y, row in enumerate(a.reshape(5, 12)):
        own = np.concatenate([np.zeros(3, int), row.astype(int)])
        out = []
        for i in range(12):
            left, up, corner = own[i], above[i + 3], above[i]
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            out.append((own[i + 3] - [0, left, up, (left + up) // 2, paeth][y]) % 256)
        raw += bytes([y]) + bytes(out)
        above = own
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"0000"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.allclose(codecs.decode_png(data), a * 257.0)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=600))
def test_byte_codecs(data):
    assert codecs.unpackbits(codecs.packbits(data)) == data
    assert codecs.unlzw(codecs.lzw(data)) == data


def test_long_lzw():
    data = np.random.default_rng(0).integers(0, 40, 60000, dtype=np.uint8).tobytes()
    assert codecs.unlzw(codecs.lzw(data)) == data


def test_files(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4, 1) * 5000
    for kind in ("png", "pgm", "qoi"):
        (tmp_path / f"a.{kind}").write_bytes(codecs.FORMATS[kind][2](a))
    (tmp_path / "b.dat").write_bytes(b"nothing")
    files = images.read(spark, str(tmp_path))
    assert sorted(r.format or "" for r in images.ping(files).collect()) == ["", "pgm", "png", "qoi"]
    assert images.decode(files).count() == 36
    back = images.encode(images.decode(files.where("path like '%png'")), "pgm", ("c0",)).collect()
    assert (back[0].height, back[0].width) == (3, 4)
    assert images.decode(files.limit(0)).count() == 0
