import numpy as np
import pytest

from tessera.sources import codecs, formats

RNG = np.random.default_rng(7)


def picture(channels, h=9, w=13):
    return np.floor(RNG.random((h, w, channels)) * 256) * 257.0


@pytest.mark.parametrize("kind", [*formats.MORE, *formats.ALIASES])
@pytest.mark.parametrize("channels", [1, 3])
def test_round_trip(kind, channels):
    a = picture(channels)
    data = formats.encode(a, kind)
    back = formats.decode(data, kind, *a.shape[:2])
    assert back.shape[:2] == a.shape[:2]
    name = formats.ALIASES.get(kind, kind)
    most = (formats.MORE if name in formats.MORE else codecs.FORMATS)[name][3]
    if name in ("c", "m", "y", "k", "o", "a", "r", "g", "b"):
        rgb = codecs._rgb(a)
        want = {"r": rgb[:, :, 0], "g": rgb[:, :, 1], "b": rgb[:, :, 2], "c": 65535 - rgb[:, :, 0], "m": 65535 - rgb[:, :, 1], "y": 65535 - rgb[:, :, 2], "k": 65535 - rgb.max(axis=2), "a": np.full(a.shape[:2], 65535.0), "o": np.zeros(a.shape[:2])}[name][:, :, None]
    elif most == 1:
        want = np.where(codecs._gray(a) >= 32767.5, 65535.0, 0.0)
    else:
        want = a if back.shape[2] == channels else np.concatenate([codecs._gray(a), np.full_like(a[:, :, :1], 65535.0)], axis=2) if back.shape[2] == 2 else codecs._rgba(a) if back.shape[2] == 4 else codecs._rgb(a) if back.shape[2] == 3 else codecs._gray(a)
    apart = {1: 1e-2, 31: 65535 / 31, -8: 65535 / 128, -11: 40}.get(most, 140 if back.shape[2] <= 2 and channels == 3 else 1e-2)
    if name in ("ycbcr", "ycbcra", "cmyk", "cmyka"):
        apart = 600
    if name == "uyvy":
        want, back, apart = codecs._gray(want), np.sum(back * [0.299, 0.587, 0.114], axis=2, keepdims=True), 600
        if channels == 3:
            return  # neighbours share their colours
    assert np.abs(back - want).max() <= apart


@pytest.mark.parametrize("kind", [k for k, v in formats.MORE.items() if v[0]])
def test_first_bytes(kind):
    assert formats.kind_of(formats.encode(picture(1), kind)) == kind


def test_long_codes():
    """Code tables that fill up and begin anew."""
    data = RNG.integers(0, 60, 40000, dtype=np.uint8).tobytes()
    for early, end in ((0, "little"), (1, "big")):
        packed = formats._lzw(data, early, end)
        assert codecs.unlzw(formats._codes(packed, early, end)) == data
    for n in (0, 1, 2, 254, 255, 256, 257, 300, 511, 512, 3837, 3838, 3839, 5000):
        part = bytes(RNG.integers(0, 256, n, dtype=np.uint8))
        for early, end in ((0, "little"), (1, "big")):
            assert codecs.unlzw(formats._codes(formats._lzw(part, early, end), early, end)) == part


def test_many_colours():
    a = picture(3, 40, 40)
    for kind in ("gif", "xpm", "png8", "map"):
        assert np.abs(formats.decode(formats.encode(a, kind), kind, 40, 40) - a).max() <= 65535 / 10 + 300


def test_known_bytes():
    """Small files written out by hand."""
    assert formats.encode(np.array([[[65535.0], [0.0]]]), "otb") == bytes([0, 2, 1, 1, 0x40])
    assert formats.encode(np.array([[[65535.0], [0.0]]]), "wbmp") == bytes([0, 0, 2, 1, 0x80])
    red = np.array([[[65535.0, 0.0, 0.0]]])
    assert formats.encode(red, "bgr") == b"\x00\x00\xff" and formats.encode(red, "rgb565") == b"\x00\xf8"
    assert formats.encode(red, "cmyk") == b"\x00\xff\xff\x00" and formats.encode(red, "mtv") == b"1 1\n\xff\x00\x00"
    assert formats.encode(red, "tga")[-3:] == b"\x00\x00\xff" and formats.encode(red, "hdr")[-4:] == b"\x80\x00\x00\x81"
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    assert (formats.decode(gif) == 65535).all()
