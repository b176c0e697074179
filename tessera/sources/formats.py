"""More image files as bytes: raw samples by channel order, and formats whose layouts are a header and rows.

Decoders take the bytes, and the height and width that go with them where a format doesn't store these. What a
format can't hold is reduced: colours to 256 where it has a palette, samples to its depth.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np

from .codecs import FORMATS, QR, _depth, _gray, _rgb, _rgba, _scaled, decode_png, encode_png, packbits, sniff, unlzw, unpackbits

Decoder = Callable[[bytes, int, int], np.ndarray]

#: Raw samples, pixel by pixel: the channels in their order. v is gray, o is opacity, Y U V are luma and colour differences.
RAW = {
    "gray": "v", "graya": "va", "rgb": "rgb", "rgba": "rgba", "rgbo": "rgbo", "bgr": "bgr", "bgra": "bgra", "bgro": "bgro", "cmyk": "cmyk", "cmyka": "cmyka", "ycbcr": "YUV", "ycbcra": "YUVa",
    "r": "r", "g": "g", "b": "b", "a": "a", "o": "o", "c": "c", "m": "m", "y": "y", "k": "k",
}


def _luma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    y = np.round(0.299 * r + 0.587 * g + 0.114 * b, 6)  # so that gray has no colour
    return y, np.round((b - y) / 1.772, 6) + QR / 2, np.round((r - y) / 1.402, 6) + QR / 2


def _from_luma(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    r, b = y + 1.402 * (v - QR / 2), y + 1.772 * (u - QR / 2)
    return np.clip(np.stack([r, (y - 0.299 * r - 0.114 * b) / 0.587, b], axis=2), 0, QR)


def _inks(rgb: np.ndarray) -> np.ndarray:
    """Cyan, magenta, yellow and black, as much black as all three hold."""
    ink = QR - rgb
    k = ink.min(axis=2, keepdims=True)
    return np.concatenate([(ink - k) * QR / np.maximum(QR - k, 1e-9), k], axis=2)


def _from_inks(inks: np.ndarray) -> np.ndarray:
    k = inks[:, :, 3:4]
    return QR - np.minimum(QR, inks[:, :, :3] * (QR - k) / QR + k)


def encode_raw(a: np.ndarray, order: str, most: int = 255) -> bytes:
    rgba = _rgba(a)
    channels = dict(zip("rgba", rgba.transpose(2, 0, 1), strict=True))
    if "v" in order:
        channels["v"] = _gray(a)[:, :, 0]
    if "o" in order:
        channels["o"] = QR - rgba[:, :, 3]
    if "cmy" in order:
        channels |= dict(zip("cmyk", _inks(rgba[:, :, :3]).transpose(2, 0, 1), strict=True))
    else:
        channels |= {c: QR - (rgba[:, :, :3].max(axis=2) if c == "k" else rgba[:, :, "cmy".index(c)]) for c in order if c in "cmyk"}
    if "Y" in order:
        channels |= dict(zip("YUV", _luma(*rgba[:, :, :3].transpose(2, 0, 1)), strict=True))
    return _depth(np.stack([channels[c] for c in order], axis=2), most, ">u2" if most > 255 else "u1").tobytes()


def decode_raw(data: bytes, h: int, w: int, order: str, most: int = 255) -> np.ndarray:
    """Gray, red, green, blue and alpha; a file of one channel gives its samples as they are."""
    a = _scaled(np.frombuffer(data, ">u2" if most > 255 else "u1", h * w * len(order)).reshape(h, w, len(order)), most)
    at = {c: a[:, :, i : i + 1] for i, c in enumerate(order)}
    if len(order) == 1:
        return a
    if "v" in at:
        return a
    if "Y" in at:
        rgb = _from_luma(*(at[c][:, :, 0] for c in "YUV"))
    elif "c" in at:
        rgb = _from_inks(np.concatenate([at[c] for c in "cmyk"], axis=2))
    else:
        rgb = np.concatenate([at[c] for c in "rgb"], axis=2)
    alpha = [at["a"]] if "a" in at else [QR - at["o"]] if "o" in at else []
    return np.concatenate([rgb, *alpha], axis=2)


def encode_uyvy(a: np.ndarray) -> bytes:
    """Two pixels share their colour differences; an odd row ends with its last pixel twice."""
    rgb = _rgb(a)
    if rgb.shape[1] % 2:
        rgb = np.concatenate([rgb, rgb[:, -1:]], axis=1)
    y, u, v = _luma(*rgb.transpose(2, 0, 1))
    pairs = np.stack([(u[:, ::2] + u[:, 1::2]) / 2, y[:, ::2], (v[:, ::2] + v[:, 1::2]) / 2, y[:, 1::2]], axis=2)
    return _depth(pairs, 255, "u1").tobytes()


def decode_uyvy(data: bytes, h: int, w: int) -> np.ndarray:
    p = _scaled(np.frombuffer(data, "u1", h * (w + w % 2) * 2).reshape(h, -1, 4), 255)
    y = p[:, :, 1::2].reshape(h, -1)
    return _from_luma(y, np.repeat(p[:, :, 0], 2, axis=1), np.repeat(p[:, :, 2], 2, axis=1))[:, :w]


def _bits(a: np.ndarray, ones: str, order: str) -> bytes:
    """Rows of bits, each filled up to a byte; ones: what a set bit means."""
    white = _gray(a)[:, :, 0] >= QR / 2
    return np.packbits(white if ones == "white" else ~white, axis=1, bitorder=order).tobytes()


def _unbits(data: bytes, h: int, w: int, ones: str, order: str) -> np.ndarray:
    n = (w + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, "u1", h * n).reshape(h, n), axis=1, bitorder=order)[:, :w].astype(bool)
    return np.where(bits if ones == "white" else ~bits, QR, 0.0)[:, :, None]


def _palette(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most 256 colours, and each pixel's: its own, or the nearest of 6 x 7 x 6 if there are more."""
    flat = _depth(_rgb(a), 255, "u1").reshape(-1, 3)
    colours, index = np.unique(flat, axis=0, return_inverse=True)
    if len(colours) > 256:
        steps = np.array([5, 6, 5])
        near = np.floor(flat / 255 * steps + 0.5).astype(int)
        colours = np.stack(np.meshgrid(*(np.arange(s + 1) for s in steps), indexing="ij"), axis=-1).reshape(-1, 3) * 255 // steps
        index = (near[:, 0] * 7 + near[:, 1]) * 6 + near[:, 2]
    table = np.zeros((256, 3), "u1")
    table[: len(colours)] = colours
    return table, index.reshape(a.shape[:2]).astype("u1")


def encode_map(a: np.ndarray) -> bytes:
    table, index = _palette(a)
    return table.tobytes() + index.tobytes()


def decode_map(data: bytes, h: int, w: int) -> np.ndarray:
    return _scaled(np.frombuffer(data, "u1", 768).reshape(256, 3)[np.frombuffer(data, "u1", h * w, 768).reshape(h, w)], 255)


def encode_rgb565(a: np.ndarray) -> bytes:
    r, g, b = (_depth(_rgb(a)[:, :, i], m, "<u2") for i, m in enumerate((31, 63, 31)))
    return (r << 11 | g << 5 | b).astype("<u2").tobytes()


def decode_rgb565(data: bytes, h: int, w: int) -> np.ndarray:
    v = np.frombuffer(data, "<u2", h * w).reshape(h, w)
    return np.stack([_scaled(v >> 11, 31), _scaled(v >> 5 & 63, 63), _scaled(v & 31, 31)], axis=2)


# ---- headers and rows --------------------------------------------------------------------------------------------
def encode_tga(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    body = _depth(a if n == 1 else _rgba(a)[:, :, [2, 1, 0, 3]] if n in (2, 4) else a[:, :, ::-1], 255, "u1")
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * body.shape[2], 0x20 | (8 if body.shape[2] == 4 else 0)) + body.tobytes()


def decode_tga(data: bytes, *_: int) -> np.ndarray:
    skip, mapped, kind, _, many, deep, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    at, n = 18 + skip, (bits + 7) // 8
    table = None
    if mapped:
        table = np.frombuffer(data, "u1", many * (deep // 8), at).reshape(many, deep // 8)
        at += many * (deep // 8)
    if kind >= 9:
        out = bytearray()
        while len(out) < h * w * n:
            c = data[at] & 127
            out += data[at + 1 : at + 1 + n] * (c + 1) if data[at] & 128 else data[at + 1 : at + 1 + n * (c + 1)]
            at += 1 + (n if data[at] & 128 else n * (c + 1))
        body = np.frombuffer(bytes(out[: h * w * n]), "u1").reshape(h, w, n)
    else:
        body = np.frombuffer(data, "u1", h * w * n, at).reshape(h, w, n)
    body = table[body[:, :, 0]] if table is not None else body
    body = body if flags & 0x20 else body[::-1]
    return _scaled(body[:, :, [2, 1, 0, 3][: body.shape[2]]] if body.shape[2] > 1 else body, 255)


def encode_sgi(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    head = struct.pack(">HBBHHHHII", 474, 0, 2, 2 if n == 1 else 3, w, h, n, 0, 65535)
    return head.ljust(512, b"\0") + _depth(a[::-1].transpose(2, 0, 1), 65535, ">u2").tobytes()


def decode_sgi(data: bytes, *_: int) -> np.ndarray:
    _, packed, size, dims, w, h, n = struct.unpack_from(">HBBHHHH", data)
    n, h = n if dims > 2 else 1, h if dims > 1 else 1
    kind, most = (">u2", 65535) if size == 2 else ("u1", 255)
    if not packed:
        return _scaled(np.frombuffer(data, kind, h * w * n, 512).reshape(n, h, w).transpose(1, 2, 0)[::-1], most)
    out = np.zeros((n, h, w))
    for k, at in enumerate(struct.unpack_from(f">{h * n}I", data, 512)):
        row: list[int] = []
        samples = np.frombuffer(data, kind, (len(data) - at) // size, at)
        i = 0
        while len(row) < w:
            c, i = int(samples[i]) & 127, i + 1
            row += list(samples[i : i + c]) if samples[i - 1] & 128 else [samples[i]] * c
            i += c if samples[i - 1] & 128 else 1
        out[k // h, k % h] = row[:w]
    return _scaled(out.transpose(1, 2, 0)[::-1], most)


def _filled(rows: np.ndarray, to: int) -> bytes:
    """Rows of bytes, each filled up to a multiple."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % to))).tobytes()


def encode_sun(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    body = _depth(a if n == 1 else _rgb(a)[:, :, ::-1], 255, "u1").reshape(h, -1)
    data = _filled(body, 2)
    return struct.pack(">8I", 0x59A66A95, w, h, 8 if n == 1 else 24, len(data), 1, 0, 0) + data


def decode_sun(data: bytes, *_: int) -> np.ndarray:
    _, w, h, bits, _, kind, _, more = struct.unpack_from(">8I", data)
    n = bits // 8
    row = w * n + w * n % 2
    body = np.frombuffer(data, "u1", h * row, 32 + more).reshape(h, row)[:, : w * n].reshape(h, w, n)
    return _scaled(body if n == 1 or kind == 3 else body[:, :, ::-1], 255)


def encode_viff(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    head = struct.pack(">8B", 0xAB, 1, 1, 3, 2, 0, 0, 0).ljust(520, b"\0") + struct.pack(">5I2f8I", w, h, 0, 0, 0, 1.0, 1.0, 1, 0, 1, n, 2, 0, 0, 0)
    return head.ljust(1024, b"\0") + _depth(a.transpose(2, 0, 1), 65535, ">u2").tobytes()


def decode_viff(data: bytes, *_: int) -> np.ndarray:
    end = ">" if data[4] == 2 else "<"
    w, h = struct.unpack_from(end + "2I", data, 520)
    n, storage = struct.unpack_from(end + "2I", data, 560)
    kind, most = (end + "u2", 65535) if storage == 2 else ("u1", 255)
    return _scaled(np.frombuffer(data, kind, h * w * n, 1024).reshape(n, h, w).transpose(1, 2, 0), most)


def encode_pcx(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    planes = _depth(a if n == 1 else _rgb(a), 255, "u1").transpose(0, 2, 1)
    stride = w + w % 2
    rows = np.pad(planes, ((0, 0), (0, 0), (0, stride - w))).reshape(-1, stride)
    out = bytearray(struct.pack("<4B6H", 10, 5, 1, 8, 0, 0, w - 1, h - 1, 72, 72) + bytes(48) + struct.pack("<BBHH", 0, planes.shape[1], stride, 1)).ljust(128, b"\0")
    for row in rows:
        edge = np.flatnonzero(np.diff(row)) + 1
        for x, y in zip(np.append(0, edge), np.append(edge, stride), strict=True):
            for k in range(x, y, 63):
                run = min(63, y - k)
                out += bytes([0xC0 | run, row[x]]) if run > 1 or row[x] >= 0xC0 else bytes([row[x]])
    return bytes(out) + (b"\x0c" + np.repeat(np.arange(256, dtype="u1"), 3).tobytes() if n == 1 else b"")


def decode_pcx(data: bytes, *_: int) -> np.ndarray:
    x0, y0, x1, y1 = struct.unpack_from("<4H", data, 4)
    planes, stride = data[65], struct.unpack_from("<H", data, 66)[0]
    h, w, at, out = y1 - y0 + 1, x1 - x0 + 1, 128, bytearray()
    while len(out) < h * planes * stride:
        run = data[at] & 0x3F if data[at] >= 0xC0 else 1
        at += data[at] >= 0xC0
        out += data[at : at + 1] * run
        at += 1
    body = np.frombuffer(bytes(out[: h * planes * stride]), "u1").reshape(h, planes, stride)[:, :, :w].transpose(0, 2, 1)
    if planes == 1:
        body = np.frombuffer(data, "u1", 768, len(data) - 768).reshape(256, 3)[body[:, :, 0]]
    return _scaled(body, 255)


def encode_dcx(a: np.ndarray) -> bytes:
    return struct.pack("<3I", 0x3ADE68B1, 12, 0) + encode_pcx(a)


def decode_dcx(data: bytes, *_: int) -> np.ndarray:
    return decode_pcx(data[struct.unpack_from("<I", data, 4)[0] :])


def _varint(n: int) -> bytes:
    out = bytes([n & 127])
    while n := n >> 7:
        out = bytes([n & 127 | 128]) + out
    return out


def encode_wbmp(a: np.ndarray) -> bytes:
    return b"\0\0" + _varint(a.shape[1]) + _varint(a.shape[0]) + _bits(a, "white", "big")


def decode_wbmp(data: bytes, *_: int) -> np.ndarray:
    at, size = 2, []
    while len(size) < 2:
        n = 0
        while data[at] & 128:
            n, at = n << 7 | data[at] & 127, at + 1
        size, at = [*size, n << 7 | data[at]], at + 1
    return _unbits(data[at:], size[1], size[0], "white", "big")


def encode_otb(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    large = max(h, w) > 255
    return struct.pack(">BHHB" if large else ">BBBB", 16 if large else 0, w, h, 1) + _bits(a, "black", "big")


def decode_otb(data: bytes, *_: int) -> np.ndarray:
    w, h = struct.unpack_from(">HH" if data[0] & 16 else ">BB", data, 1)
    return _unbits(data[6 if data[0] & 16 else 4 :], h, w, "black", "big")


def encode_rgf(a: np.ndarray) -> bytes:
    return bytes([a.shape[1], a.shape[0]]) + _bits(a, "black", "little")


def decode_rgf(data: bytes, *_: int) -> np.ndarray:
    return _unbits(data[2:], data[1], data[0], "black", "little")


def encode_mtv(a: np.ndarray) -> bytes:
    return f"{a.shape[1]} {a.shape[0]}\n".encode() + _depth(_rgb(a), 255, "u1").tobytes()


def decode_mtv(data: bytes, *_: int) -> np.ndarray:
    head, body = data.split(b"\n", 1)
    w, h = map(int, head.split())
    return _scaled(np.frombuffer(body, "u1", h * w * 3).reshape(h, w, 3), 255)


def encode_pgx(a: np.ndarray) -> bytes:
    return f"PG ML + 16 {a.shape[1]} {a.shape[0]}\n".encode() + _depth(_gray(a), 65535, ">u2").tobytes()


def decode_pgx(data: bytes, *_: int) -> np.ndarray:
    head, body = data.split(b"\n", 1)
    order, bits, w, h = re.match(rb"PG\s+(ML|LM)\s*\+?\s*(\d+)\s+(\d+)\s+(\d+)", head).groups()
    kind = ("<" if order == b"LM" else ">") + ("u2" if int(bits) > 8 else "u1")
    return _scaled(np.frombuffer(body, kind, int(w) * int(h)).reshape(int(h), int(w), 1), (1 << int(bits)) - 1)


def encode_fits(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    cards = [("SIMPLE", "T"), ("BITPIX", 16), ("NAXIS", 2 if n == 1 else 3), ("NAXIS1", w), ("NAXIS2", h), *([("NAXIS3", n)] if n > 1 else []), ("BSCALE", 1), ("BZERO", 32768)]
    head = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END"
    body = (_depth(a[::-1].transpose(2, 0, 1), 65535, "i4") - 32768).astype(">i2").tobytes()
    return head.encode().ljust(-(-len(head) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def decode_fits(data: bytes, *_: int) -> np.ndarray:
    end = next(i for i in range(0, len(data), 80) if data[i : i + 8].rstrip() == b"END")
    cards = [data[i : i + 80].decode("ascii", "replace") for i in range(0, end, 80)]
    head = {c[:8].strip(): c[10:].split("/")[0].strip() for c in cards if c[8:10] == "= "}
    w, h, n, bits = (int(head.get(k, "1")) for k in ("NAXIS1", "NAXIS2", "NAXIS3", "BITPIX"))
    scale, zero = float(head.get("BSCALE", "1")), float(head.get("BZERO", "0"))
    kind = {8: "u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}[bits]
    v = np.frombuffer(data, kind, h * w * n, -(-(end + 80) // 2880) * 2880).reshape(n, h, w).transpose(1, 2, 0)[::-1] * scale + zero
    return v * (QR / {8: 255, 16: 65535, 32: 4294967295}.get(bits, 1))


def encode_vicar(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    label = f"LBLSIZE=512             FORMAT='BYTE'  TYPE='IMAGE'  BUFSIZE={w}  DIM=3  EOL=0  RECSIZE={w}  ORG='BSQ'  NL={h}  NS={w}  NB=1  N1={w}  N2={h}  N3=1  N4=0  NBB=0  NLB=0"
    return label.encode().ljust(512, b"\0") + _depth(_gray(a), 255, "u1").tobytes()


def decode_vicar(data: bytes, *_: int) -> np.ndarray:
    size = int(re.match(rb"LBLSIZE=(\d+)", data)[1])
    h, w = (int(re.search(rb"\b" + k + rb"=(\d+)", data[:size])[1]) for k in (b"NL", b"NS"))
    return _scaled(np.frombuffer(data, "u1", h * w, size).reshape(h, w, 1), 255)


def encode_phm(a: np.ndarray) -> bytes:
    n = 1 if a.shape[2] < 3 else 3
    return f"P{'h' if n == 1 else 'H'}\n{a.shape[1]} {a.shape[0]}\n-1.0\n".encode() + (a[::-1, :, :n] / QR).astype("<f2").tobytes()


def decode_phm(data: bytes, *_: int) -> np.ndarray:
    kind, size, scale, body = data.split(b"\n", 3)
    w, h = map(int, size.split())
    n = 3 if kind == b"PH" else 1
    return np.frombuffer(body, "<f2" if float(scale) < 0 else ">f2", h * w * n).reshape(h, w, n)[::-1].astype(np.float64) * QR


def encode_hdr(a: np.ndarray) -> bytes:
    rgb = np.maximum(_rgb(a) / QR, 0)
    most = rgb.max(axis=2)
    mantissa, power = np.frexp(most)
    scale = np.where(most > 1e-32, np.ldexp(1.0, 8 - power), 0.0)
    body = np.concatenate([np.floor(rgb * scale[:, :, None]), np.where(most > 1e-32, power + 128, 0)[:, :, None]], axis=2).astype("u1")
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {a.shape[0]} +X {a.shape[1]}\n".encode() + body.tobytes()


def decode_hdr(data: bytes, *_: int) -> np.ndarray:
    m = re.search(rb"\n\n-Y (\d+) \+X (\d+)\n", data)
    h, w, at = int(m[1]), int(m[2]), m.end()
    rows = np.zeros((h, w, 4), "u1")
    for y in range(h):
        if data[at : at + 2] == b"\2\2" and data[at + 2] << 8 | data[at + 3] == w:  # four planes in runs
            at += 4
            for c in range(4):
                line = bytearray()
                while len(line) < w:
                    n = data[at]
                    line += data[at + 1 : at + 2] * (n - 128) if n > 128 else data[at + 1 : at + 1 + n]
                    at += 2 if n > 128 else 1 + n
                rows[y, :, c] = np.frombuffer(bytes(line), "u1")
        else:
            rows[y] = np.frombuffer(data, "u1", w * 4, at).reshape(w, 4)
            at += w * 4
    scale = np.where(rows[:, :, 3] > 0, np.ldexp(1.0, rows[:, :, 3].astype(int) - 136), 0.0)
    return rows[:, :, :3] * scale[:, :, None] * QR


def encode_xpm(a: np.ndarray) -> bytes:
    table, index = _palette(a)
    letters = "abcdefghijklmnop"
    used = np.unique(index)
    name = [letters[i >> 4] + letters[i & 15] for i in range(256)]
    lines = [f"{a.shape[1]} {a.shape[0]} {len(used)} 2", *(f"{name[i]} c #{bytes(table[i]).hex().upper()}" for i in used), *("".join(name[i] for i in row) for row in index)]
    return ("/* XPM */\nstatic char *image[] = {\n" + ",\n".join(f'"{x}"' for x in lines) + "\n};\n").encode()


def decode_xpm(data: bytes, *_: int) -> np.ndarray:
    lines = re.findall(r'"([^"]*)"', data.decode("latin-1"))
    w, h, n, size = map(int, lines[0].split()[:4])
    colours = {}
    for x in lines[1 : 1 + n]:
        c = re.search(r"\bc\s+#([0-9a-fA-F]+)", x[size:])[1]
        k = len(c) // 3
        colours[x[:size]] = [int(c[i * k : i * k + k], 16) / (16**k - 1) * QR for i in range(3)]
    return np.array([[colours[row[i * size : (i + 1) * size]] for i in range(w)] for row in lines[1 + n : 1 + n + h]])


def encode_aai(a: np.ndarray) -> bytes:
    return struct.pack("<2I", a.shape[1], a.shape[0]) + _depth(_rgba(a)[:, :, [2, 1, 0, 3]], 255, "u1").tobytes()


def decode_aai(data: bytes, *_: int) -> np.ndarray:
    w, h = struct.unpack_from("<2I", data)
    return _scaled(np.frombuffer(data, "u1", h * w * 4, 8).reshape(h, w, 4)[:, :, [2, 1, 0, 3]], 255)


def encode_dds(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    head = struct.pack("<4s7I44x", b"DDS ", 124, 0x100F, h, w, w * 4, 0, 0) + struct.pack("<8I", 32, 0x41, 0, 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + struct.pack("<5I", 0x1000, 0, 0, 0, 0)
    return head + _depth(_rgba(a)[:, :, [2, 1, 0, 3]], 255, "u1").tobytes()


def decode_dds(data: bytes, *_: int) -> np.ndarray:
    h, w = struct.unpack_from("<2I", data, 12)
    flags, _, bits, *masks = struct.unpack_from("<7I", data, 80)
    if flags & 4:
        raise ValueError("compressed blocks are not read")
    n = bits // 8
    body = np.frombuffer(data, "u1", h * w * n, 128).reshape(h, w, n)
    order = [(m & -m).bit_length() // 8 for m in masks if m]
    return _scaled(body[:, :, order[: 4 if flags & 1 else 3]], 255)


# ---- bitmaps with a device-independent header --------------------------------------------------------------------
def _rows24(a: np.ndarray) -> bytes:
    return _filled(_depth(_rgb(a)[::-1, :, ::-1], 255, "u1").reshape(a.shape[0], -1), 4)


def encode_dib(a: np.ndarray) -> bytes:
    body = _rows24(a)
    return struct.pack("<3I2H6I", 40, a.shape[1], a.shape[0], 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode_dib(data: bytes, *_: int, double: bool = False) -> np.ndarray:
    """double: the height counts a mask behind the image too."""
    size = struct.unpack_from("<I", data)[0]
    w, h, _, bits = struct.unpack_from("<4H", data, 4) if size == 12 else struct.unpack_from("<2i2H", data, 4)
    down, h = h < 0, abs(h) // (2 if double else 1)
    used = struct.unpack_from("<I", data, 32)[0] if size >= 36 else 0
    colours = (used or 1 << bits) if bits <= 8 else 0
    step = 3 if size == 12 else 4
    at, stride = size + colours * step, (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, "u1", h * stride, at).reshape(h, stride)
    if bits <= 8:
        index = np.unpackbits(rows, axis=1).reshape(h, -1, bits) if bits < 8 else rows[:, :w]
        if bits < 8:
            index = (index * (1 << np.arange(bits)[::-1])).sum(axis=2)[:, :w]
        out = np.frombuffer(data, "u1", colours * step, size).reshape(colours, step)[:, 2::-1][index]
    else:
        out = rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, [2, 1, 0, 3][: bits // 8]]
    return _scaled(out if down else out[::-1], 255)


def encode_bmp2(a: np.ndarray) -> bytes:
    body = _rows24(a)
    return struct.pack("<2sI2HI", b"BM", 26 + len(body), 0, 0, 26) + struct.pack("<I4H", 12, a.shape[1], a.shape[0], 1, 24) + body


def encode_bmp3(a: np.ndarray) -> bytes:
    body = encode_dib(a)
    return struct.pack("<2sI2HI", b"BM", 14 + len(body), 0, 0, 54) + body


def decode_bmp_any(data: bytes, *_: int) -> np.ndarray:
    return decode_dib(data[14:])


def _icon(kind: int) -> Callable[[np.ndarray], bytes]:
    def encode(a: np.ndarray) -> bytes:
        h, w = a.shape[:2]
        body = _depth(_rgba(a)[::-1, :, [2, 1, 0, 3]], 255, "u1").tobytes() + bytes((w + 31) // 32 * 4 * h)
        image = struct.pack("<3I2H6I", 40, w, 2 * h, 1, 32, 0, len(body), 0, 0, 0, 0) + body
        return struct.pack("<3H", 0, kind, 1) + struct.pack("<4B2H2I", w % 256, h % 256, 0, 0, 1 if kind == 1 else 0, 32 if kind == 1 else 0, len(image), 22) + image

    return encode


def decode_icon(data: bytes, *_: int) -> np.ndarray:
    """The first of the images."""
    size, at = struct.unpack_from("<2I", data, 14)
    image = data[at : at + size]
    return decode_png(image) if image[:4] == b"\x89PNG" else decode_dib(image, double=True)


# ---- codes of variable width -------------------------------------------------------------------------------------
def _lzw(data: bytes, early: int, end: str) -> bytes:
    """Byte strings as codes of 9 to 12 bits; 256 begins anew, 257 ends. early: how many codes before a width is full the next one starts."""
    table: dict[bytes, int] = {}
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code if end == "big" else held | code << bits
        bits += width
        while bits >= 8:
            bits -= 8
            if end == "big":
                out.append(held >> bits & 255)
                held &= (1 << bits) - 1
            else:
                out.append(held & 255)
                held >>= 8

    put(256)
    table, following, run = {bytes([i]): i for i in range(256)}, 258, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if run + c in table:
            run += c
            continue
        put(table[run])
        table[run + c] = following
        following += 1
        run = c
        if following + early > (1 << width) and width < 12:
            width += 1
        elif following >= 4094:
            put(256)
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
    if run:
        put(table[run])
        following += 1
        if following + early > (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255 if end == "big" else held & 255)
    return bytes(out)


def _codes(data: bytes, early: int, end: str, begin: int = 256) -> list[int]:
    """The codes of such a stream; ``begin`` is the code that begins anew."""
    out, first = [], begin.bit_length()
    width, following, at, held, bits = first, begin + 2, 0, 0, 0
    fresh = True
    while True:
        while bits < width:
            if at >= len(data):
                return out
            held = held << 8 | data[at] if end == "big" else held | data[at] << bits
            bits, at = bits + 8, at + 1
        if end == "big":
            code = held >> (bits - width)
            held &= (1 << (bits - width)) - 1
        else:
            code = held & ((1 << width) - 1)
            held >>= width
        bits -= width
        out.append(code)
        if code == begin + 1:
            return out
        if code == begin:
            width, following, fresh = first, begin + 2, True
            continue
        following += not fresh  # the first code after a beginning adds nothing
        fresh = False
        if following + early >= (1 << width) and width < 12:
            width += 1


def _gif(version: bytes) -> Callable[[np.ndarray], bytes]:
    def encode(a: np.ndarray) -> bytes:
        table, index = _palette(a)
        h, w = a.shape[:2]
        body = _lzw(index.tobytes(), 0, "little")
        blocks = b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255))
        return version + struct.pack("<2H3B", w, h, 0xF7, 0, 0) + table.tobytes() + struct.pack("<B4HB", 0x2C, 0, 0, w, h, 0) + b"\x08" + blocks + b"\0;"

    return encode


def decode_gif(data: bytes, *_: int) -> np.ndarray:
    """The first frame, on a canvas of its own size."""
    at, table = 13, None
    if data[10] & 0x80:
        n = 2 << (data[10] & 7)
        table = np.frombuffer(data, "u1", 3 * n, at).reshape(n, 3)
        at += 3 * n
    while data[at] != 0x2C:
        if data[at] != 0x21:
            raise ValueError("no frame")
        at += 2
        while data[at]:
            at += 1 + data[at]
        at += 1
    _, _, w, h, flags = struct.unpack_from("<4HB", data, at + 1)
    at += 10
    if flags & 0x80:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, "u1", 3 * n, at).reshape(n, 3)
        at += 3 * n
    least, at, body = data[at], at + 1, bytearray()
    while data[at]:
        body += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    begin = 1 << least
    codes = _codes(bytes(body), 0, "little", begin)
    shifted = [c if c < begin else c - begin + 256 for c in codes]
    index = np.frombuffer(unlzw(shifted)[: h * w], "u1").reshape(h, w)
    if flags & 0x40:  # interlaced
        order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
        index = index[np.argsort(order)]
    return _scaled(table[index], 255)


#: Compression of TIFF strips by its number.
STRIPS: dict[int, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    1: (lambda b: b, lambda b: b), 5: (lambda b: _lzw(b, 1, "big"), lambda b: unlzw(_codes(b, 1, "big"))), 8: (zlib.compress, zlib.decompress), 32946: (zlib.compress, zlib.decompress), 32773: (packbits, unpackbits),
}


def _tiff(compression: int, big: bool = False) -> Callable[[np.ndarray], bytes]:
    def encode(a: np.ndarray) -> bytes:
        h, w, n = a.shape
        body = STRIPS[compression][0](_depth(a, 65535, "<u2").tobytes())
        head, size = (struct.pack("<2s3HQ", b"II", 43, 8, 0, 16), 8) if big else (struct.pack("<2sHI", b"II", 42, 8), 4)
        shorts = lambda v: (3, v)
        longs = lambda *v: (16 if big else 4, list(v))
        tags = {256: longs(w), 257: longs(h), 258: shorts([16] * n), 259: shorts([compression]), 262: shorts([2 if n >= 3 else 1]), 273: longs(0), 277: shorts([n]), 278: longs(h), 279: longs(len(body)), 339: shorts([1] * n)}
        if n in (2, 4):
            tags[338] = shorts([2])
        start = len(head) + (8 if big else 2) + len(tags) * (20 if big else 12) + size
        more, entries = b"", b""
        room = start + sum(len(v) * 2 for _, (k, v) in tags.items() if k == 3 and len(v) * 2 > size)
        tags[273] = longs(room + room % 2)
        for tag, (kind, v) in sorted(tags.items()):
            raw = struct.pack(f"<{len(v)}{'H' if kind == 3 else 'Q' if big else 'I'}", *v)
            if len(raw) > size:
                raw, more = struct.pack("<Q" if big else "<I", start + len(more)), more + raw
            entries += struct.pack("<HHQ" if big else "<HHI", tag, kind, len(v)) + raw.ljust(size, b"\0")
        out = head + struct.pack("<Q" if big else "<H", len(tags)) + entries + bytes(size) + more
        return out.ljust(room + room % 2, b"\0") + body

    return encode


def decode_tiff(data: bytes, *_: int) -> np.ndarray:
    """The first image of a file in strips: 8 or 16 bits, gray, colour or a palette, of either byte order."""
    e = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(e + "H", data, 2)[0] == 43
    at = struct.unpack_from(e + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count = struct.unpack_from(e + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(count):
        p = at + i * (20 if big else 12)
        tag, kind, n = struct.unpack_from(e + ("HHQ" if big else "HHI"), data, p)
        p += 12 if big else 8
        letter = {1: "B", 3: "H", 4: "I", 16: "Q"}.get(kind)
        if letter is None:
            continue
        if n * struct.calcsize(letter) > (8 if big else 4):
            p = struct.unpack_from(e + ("Q" if big else "I"), data, p)[0]
        tags[tag] = struct.unpack_from(f"{e}{n}{letter}", data, p)
    w, h, n, bits = tags[256][0], tags[257][0], tags.get(277, (1,))[0], tags.get(258, (1,))[0]
    if bits not in (8, 16) or 273 not in tags:
        raise ValueError("only strips of 8 or 16 bits are read")
    unpack = STRIPS[tags.get(259, (1,))[0]][1]
    body = b"".join(unpack(data[a : a + b]) for a, b in zip(tags[273], tags[279], strict=True))
    v = np.frombuffer(body, e + "u2" if bits == 16 else "u1")
    v = v[: h * w * n].reshape(n, h, w).transpose(1, 2, 0) if tags.get(284, (1,))[0] == 2 else v[: h * w * n].reshape(h, w, n)
    if tags.get(317, (1,))[0] == 2:
        v = np.cumsum(v, axis=1, dtype=v.dtype.newbyteorder("="))
    if tags[262][0] == 3:
        return _scaled(np.array(tags[320]).reshape(3, -1).T[v[:, :, 0]], 65535)
    out = _scaled(v, (1 << bits) - 1)
    return QR - out if tags[262][0] == 0 else out


def _psd(version: int) -> Callable[[np.ndarray], bytes]:
    def encode(a: np.ndarray) -> bytes:
        h, w, n = a.shape
        return struct.pack(">4sH6xHIIHH", b"8BPS", version, n, h, w, 16, 1 if n < 3 else 3) + bytes(8) + bytes(4 if version == 1 else 8) + b"\0\0" + _depth(a.transpose(2, 0, 1), 65535, ">u2").tobytes()

    return encode


def decode_psd(data: bytes, *_: int) -> np.ndarray:
    """The merged image, plain or in runs."""
    _, version, n, h, w, bits, mode = struct.unpack_from(">4sH6xHIIHH", data)
    at = 26
    for wide in (False, False, version == 2):
        at += (8 if wide else 4) + struct.unpack_from(">Q" if wide else ">I", data, at)[0]
    packed, at = struct.unpack_from(">H", data, at)[0], at + 2
    if packed == 1:
        sizes = struct.unpack_from(f">{h * n}{'I' if version == 2 else 'H'}", data, at)
        at += h * n * (4 if version == 2 else 2)
        body = b""
        for s in sizes:
            body, at = body + unpackbits(data[at : at + s]), at + s
    else:
        body = data[at:]
    kind, most = (">u2", 65535) if bits == 16 else ("u1", 255)
    out = _scaled(np.frombuffer(body, kind, h * w * n).reshape(n, h, w).transpose(1, 2, 0), most)
    if mode == 4:
        return _from_inks(QR - out[:, :, :4])
    return out


def encode_png8(a: np.ndarray) -> bytes:
    table, index = _palette(a)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in index)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 3, 0, 0, 0)) + chunk(b"PLTE", table.tobytes()) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_inline(a: np.ndarray) -> bytes:
    return b"data:image/png;base64," + base64.b64encode(encode_png(a))


def decode_inline(data: bytes, *_: int) -> np.ndarray:
    body = base64.b64decode(data.split(b",", 1)[1])
    return decode(body)


#: name -> (what its files begin with, or nothing; decoder; encoder; the largest sample that it stores)
MORE: dict[str, tuple[bytes, Decoder, Callable[[np.ndarray], bytes], int]] = {
    **{name: (b"", lambda d, h, w, o=order: decode_raw(d, h, w, o), lambda a, o=order: encode_raw(a, o), 255) for name, order in RAW.items()},
    "uyvy": (b"", decode_uyvy, encode_uyvy, 255), "mono": (b"", lambda d, h, w: _unbits(d, h, w, "black", "little"), lambda a: _bits(a, "black", "little"), 1), "map": (b"", decode_map, encode_map, 255), "rgb565": (b"", decode_rgb565, encode_rgb565, 31),
    "tga": (b"", decode_tga, encode_tga, 255), "sgi": (b"\x01\xda", decode_sgi, encode_sgi, 65535), "sun": (b"\x59\xa6\x6a\x95", decode_sun, encode_sun, 255), "viff": (b"\xab\x01", decode_viff, encode_viff, 65535),
    "pcx": (b"\x0a\x05\x01", decode_pcx, encode_pcx, 255), "dcx": (b"\xb1\x68\xde\x3a", decode_dcx, encode_dcx, 255), "wbmp": (b"", decode_wbmp, encode_wbmp, 1), "otb": (b"", decode_otb, encode_otb, 1), "rgf": (b"", decode_rgf, encode_rgf, 1),
    "mtv": (b"", decode_mtv, encode_mtv, 255), "pgx": (b"PG ", decode_pgx, encode_pgx, 65535), "fits": (b"SIMPLE", decode_fits, encode_fits, 65535), "vicar": (b"LBLSIZE", decode_vicar, encode_vicar, 255), "phm": (b"Ph\n", decode_phm, encode_phm, -11),
    "hdr": (b"#?RADIANCE", decode_hdr, encode_hdr, -8), "xpm": (b"/* XPM */", decode_xpm, encode_xpm, 255), "aai": (b"", decode_aai, encode_aai, 255), "dds": (b"DDS ", decode_dds, encode_dds, 255),
    "dib": (b"", decode_dib, encode_dib, 255), "bmp2": (b"", decode_bmp_any, encode_bmp2, 255), "bmp3": (b"", decode_bmp_any, encode_bmp3, 255), "ico": (b"\0\0\1\0", decode_icon, _icon(1), 255), "cur": (b"\0\0\2\0", decode_icon, _icon(2), 255),
    "gif": (b"GIF89a", decode_gif, _gif(b"GIF89a"), 255), "gif87": (b"GIF87a", decode_gif, _gif(b"GIF87a"), 255), "tiff": (b"II*\0", decode_tiff, _tiff(1), 65535), "tiff_lzw": (b"", decode_tiff, _tiff(5), 65535), "tiff_zip": (b"", decode_tiff, _tiff(8), 65535),
    "tiff_packbits": (b"", decode_tiff, _tiff(32773), 65535), "tiff64": (b"II+\0", decode_tiff, _tiff(1, True), 65535), "psd": (b"8BPS\0\1", decode_psd, _psd(1), 65535), "psb": (b"8BPS\0\2", decode_psd, _psd(2), 65535),
    "png8": (b"", lambda d, *_: decode_png(d), encode_png8, 255), "png24": (b"", lambda d, *_: decode_png(d), lambda a: encode_png(_rgb(a), 8), 255), "png32": (b"", lambda d, *_: decode_png(d), lambda a: encode_png(_rgba(a), 8), 255),
    "png48": (b"", lambda d, *_: decode_png(d), lambda a: encode_png(_rgb(a), 16), 65535), "png64": (b"", lambda d, *_: decode_png(d), lambda a: encode_png(_rgba(a), 16), 65535), "inline": (b"data:", decode_inline, encode_inline, 65535),
}
#: Other names of formats.
ALIASES = {
    "ff": "farbfeld", "pnm": "ppm", "icb": "tga", "vda": "tga", "vst": "tga", "ras": "sun", "xv": "viff", "fts": "fits", "tif": "tiff", "png00": "png", "icon": "ico", "icn": "ico", "icodib": "dib", "pal": "uyvy", "data": "inline",
}


def names() -> list[str]:
    return [*FORMATS, *MORE, *ALIASES]


def kind_of(data: bytes) -> str | None:
    """The format by a file's first bytes; the longest beginning that fits."""
    found = [(len(magic), name) for name, (magic, *_) in MORE.items() if magic and data.startswith(magic)]
    if data[:4] == b"MM\0*":
        found.append((4, "tiff"))
    if data[:2] == b"PH":
        found.append((2, "phm"))
    known = sniff(data)
    if known is not None:
        found.append((len(FORMATS[known][0]), known))
    return max(found, default=(0, None))[1]


def encode(a: np.ndarray, kind: str) -> bytes:
    kind = ALIASES.get(kind, kind)
    return (MORE if kind in MORE else FORMATS)[kind][2](a)


def decode(data: bytes, kind: str | None = None, height: int = 0, width: int = 0) -> np.ndarray:
    """``kind`` and the size are needed where a file's first bytes don't say them."""
    kind = ALIASES.get(kind, kind) or kind_of(data)
    if kind is None:
        raise ValueError("unknown format")
    return MORE[kind][1](data, height, width) if kind in MORE else FORMATS[kind][1](data)
