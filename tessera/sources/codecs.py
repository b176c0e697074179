"""Image files as bytes: decoders give an array of height x width x channels on 0..QR, encoders take one.

Formats that need no codec library: PNM (P1 to P7), PFM, farbfeld, raw samples, text, XBM, BMP, QOI, PNG and
AVS; and the byte codecs packbits, deflate and LZW.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np

QR = 65535.0


def _scaled(a: np.ndarray, most: int) -> np.ndarray:
    return a.astype(np.float64) / most * QR


def _depth(a: np.ndarray, most: int, kind: str) -> np.ndarray:
    return np.floor(np.clip(a, 0, QR) / QR * most + 0.5).astype(kind)


def _gray(a: np.ndarray) -> np.ndarray:
    return a[:, :, :1] if a.shape[2] < 3 else a[:, :, :1] * 0.212656 + a[:, :, 1:2] * 0.715158 + a[:, :, 2:3] * 0.072186


def _rgb(a: np.ndarray) -> np.ndarray:
    return a[:, :, :3] if a.shape[2] >= 3 else np.repeat(a[:, :, :1], 3, axis=2)


def _rgba(a: np.ndarray) -> np.ndarray:
    alpha = a[:, :, 3:4] if a.shape[2] > 3 else a[:, :, 1:2] if a.shape[2] == 2 else np.full(a.shape[:2] + (1,), QR)
    return np.concatenate([_rgb(a), alpha], axis=2)


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """n whole numbers after the magic, comments left out; the place behind the white space that ends them."""
    at, out = 2, []
    while len(out) < n:
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken header")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1


def decode_pnm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    if kind == b"7":
        head, body = data.split(b"ENDHDR\n", 1)
        field = {k: int(v) for k, v in re.findall(rb"(WIDTH|HEIGHT|DEPTH|MAXVAL) (\d+)", head)}
        w, h, n, most = (field[k] for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        return _scaled(np.frombuffer(body, ">u2" if most > 255 else "u1", h * w * n).reshape(h, w, n), most)
    if kind in b"14":
        (w, h), at = _header(data, 2)
        if kind == b"1":
            bits = np.array([c == 0x31 for c in re.sub(rb"\s", b"", data[at - 1 :])[: w * h]])
        else:
            rows = np.frombuffer(data, "u1", h * ((w + 7) // 8), at).reshape(h, -1)
            bits = np.unpackbits(rows, axis=1)[:, :w]
        return (1 - bits.reshape(h, w, 1).astype(np.float64)) * QR
    (w, h, most), at = _header(data, 3)
    n = 3 if kind in b"36" else 1
    if kind in b"23":
        return _scaled(np.array(data[at - 1 :].split()[: w * h * n], dtype=np.int64).reshape(h, w, n), most)
    return _scaled(np.frombuffer(data, ">u2" if most > 255 else "u1", h * w * n, at).reshape(h, w, n), most)


def _pnm(magic: str, most: int) -> Callable[[np.ndarray], bytes]:
    def encode(a: np.ndarray) -> bytes:
        a = _rgb(a) if magic in ("P3", "P6") else _gray(a)
        h, w, n = a.shape
        v = _depth(a, most, ">u2" if most > 255 else "u1")
        head = f"{magic}\n{w} {h}\n{most}\n".encode()
        return head + (v.tobytes() if magic in ("P5", "P6") else b"\n".join(b" ".join(str(x).encode() for x in row) for row in v.reshape(h, w * n)) + b"\n")

    return encode


def encode_pbm(a: np.ndarray) -> bytes:
    bits = _gray(a)[:, :, 0] < QR / 2
    return f"P4\n{a.shape[1]} {a.shape[0]}\n".encode() + np.packbits(bits, axis=1).tobytes()


def encode_pam(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {n}\nMAXVAL 65535\nENDHDR\n".encode() + _depth(a, 65535, ">u2").tobytes()


def decode_pfm(data: bytes) -> np.ndarray:
    magic, size, scale, body = data.split(b"\n", 3)
    w, h = map(int, size.split())
    n = 3 if magic == b"PF" else 1
    return np.frombuffer(body, "<f4" if float(scale) < 0 else ">f4", h * w * n).reshape(h, w, n)[::-1].astype(np.float64) * QR


def encode_pfm(a: np.ndarray) -> bytes:
    a = _rgb(a) if a.shape[2] >= 3 else _gray(a)
    return f"{'PF' if a.shape[2] == 3 else 'Pf'}\n{a.shape[1]} {a.shape[0]}\n-1.0\n".encode() + (a[::-1] / QR).astype("<f4").tobytes()


def decode_farbfeld(data: bytes) -> np.ndarray:
    w, h = struct.unpack(">II", data[8:16])
    return np.frombuffer(data, ">u2", h * w * 4, 16).reshape(h, w, 4).astype(np.float64)


def encode_farbfeld(a: np.ndarray) -> bytes:
    return b"farbfeld" + struct.pack(">II", a.shape[1], a.shape[0]) + _depth(_rgba(a), 65535, ">u2").tobytes()


def decode_avs(data: bytes) -> np.ndarray:
    w, h = struct.unpack(">II", data[:8])
    return _scaled(np.frombuffer(data, "u1", h * w * 4, 8).reshape(h, w, 4)[:, :, [1, 2, 3, 0]], 255)


def encode_avs(a: np.ndarray) -> bytes:
    return struct.pack(">II", a.shape[1], a.shape[0]) + _depth(_rgba(a)[:, :, [3, 0, 1, 2]], 255, "u1").tobytes()


def decode_txt(data: bytes) -> np.ndarray:
    """Lines ``x,y: (values)`` under a header of width, height and maximum."""
    lines = data.decode().splitlines()
    w, h, most = map(int, lines[0].split(":")[1].split(",")[:3])
    rows = [re.match(r"(\d+),(\d+): \(([^)]*)\)", x) for x in lines[1:]]
    n = len(rows[0][3].split(","))
    out = np.zeros((h, w, n))
    for m in rows:
        out[int(m[2]), int(m[1])] = [float(v) for v in m[3].split(",")]
    return out / most * QR


def encode_txt(a: np.ndarray) -> bytes:
    h, w, n = a.shape
    v = _depth(a, 65535, "u2")
    lines = [f"# pixels: {w},{h},65535,{'gray' if n == 1 else 'srgb'}"]
    return "\n".join(lines + [f"{x},{y}: ({','.join(map(str, v[y, x]))})" for y in range(h) for x in range(w)]).encode() + b"\n"


def decode_xbm(data: bytes) -> np.ndarray:
    w, h = (int(re.search(rb"_%s\s+(\d+)" % k, data)[1]) for k in (b"width", b"height"))
    rows = np.array([int(x, 16) for x in re.findall(rb"0x([0-9A-Fa-f]+)", data)], "u1").reshape(h, -1)
    return (1 - np.unpackbits(rows, axis=1, bitorder="little")[:, :w].astype(np.float64))[:, :, None] * QR


def encode_xbm(a: np.ndarray) -> bytes:
    bits = np.packbits(_gray(a)[:, :, 0] < QR / 2, axis=1, bitorder="little")
    return f"#define image_width {a.shape[1]}\n#define image_height {a.shape[0]}\nstatic char image_bits[] = {{\n{', '.join(f'0x{b:02x}' for b in bits.ravel())} }};\n".encode()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed, 24 or 32 bits."""
    start, _, w, h = struct.unpack("<IIii", data[10:26])
    bits, packing = struct.unpack("<HI", data[28:34])
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError("a palette or packed bitmap")
    stride = (abs(w) * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, "u1", stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return _scaled((rows if h < 0 else rows[::-1])[:, :, [2, 1, 0]], 255)


def encode_bmp(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), "u1")
    rows[:, : w * 3] = _depth(_rgb(a)[::-1, :, ::-1], 255, "u1").reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_qoi(data: bytes) -> np.ndarray:
    w, h, n = struct.unpack(">IIB", data[4:13])
    out, seen, p, at, i = np.zeros((h * w, 4), "u1"), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, 0
    while i < h * w:
        b = data[at]
        at += 1
        run = 1
        if b == 0xFE:
            p = (*data[at : at + 3], p[3])
            at += 3
        elif b == 0xFF:
            p = tuple(data[at : at + 4])
            at += 4
        elif b >> 6 == 0:
            p = seen[b]
        elif b >> 6 == 1:
            p = ((p[0] + (b >> 4 & 3) - 2) & 255, (p[1] + (b >> 2 & 3) - 2) & 255, (p[2] + (b & 3) - 2) & 255, p[3])
        elif b >> 6 == 2:
            g, c = (b & 63) - 32, data[at]
            at += 1
            p = ((p[0] + g + (c >> 4) - 8) & 255, (p[1] + g) & 255, (p[2] + g + (c & 15) - 8) & 255, p[3])
        else:
            run = (b & 63) + 1
        seen[(p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64] = p
        out[i : i + run] = p
        i += run
    return _scaled(out.reshape(h, w, 4)[:, :, :n], 255)


def encode_qoi(a: np.ndarray) -> bytes:
    """Runs, the table of seen colours, and whole pixels."""
    h, w = a.shape[:2]
    out, seen, last, run = bytearray(b"qoif" + struct.pack(">IIBB", w, h, 4, 0)), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for p in map(tuple, _depth(_rgba(a), 255, "u1").reshape(-1, 4).tolist()):
        if p == last:
            run += 1
            if run == 62:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        k = (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64
        if seen[k] == p:
            out.append(k)
        else:
            out += bytes([0xFE, *p[:3]]) if p[3] == last[3] else bytes([0xFF, *p])
            seen[k] = p
        last = p
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + bytes(7) + b"\x01"


def decode_png(data: bytes) -> np.ndarray:
    """Eight or sixteen bits, gray, colour or palette, not interlaced."""
    at, parts, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, "u1").reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
    if bits not in (8, 16) or interlaced:
        raise ValueError("an interlaced image, or one of few bits")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = channels * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), "u1").reshape(h, 1 + w * step)
    rows = np.zeros((h + 1, w * step + step), np.int64)  # a row above and a pixel to the left, all 0
    for y in range(h):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        if kind in (0, 2):
            rows[y + 1, step:] = (line + (rows[y, step:] if kind == 2 else 0)) & 255
            continue
        own, above = rows[y + 1], rows[y]
        for i in range(w * step):
            a, b, c = own[i], above[i + step], above[i]
            if kind == 1:
                guess = a
            elif kind == 3:
                guess = (a + b) // 2
            else:
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
            own[i + step] = (line[i] + guess) & 255
    flat = rows[1:, step:].astype("u1")
    if colour == 3:
        return _scaled(palette[flat], 255)
    return _scaled((flat.copy().view(">u2") if bits == 16 else flat).reshape(h, w, channels), 65535 if bits == 16 else 255)


def encode_png(a: np.ndarray, bits: int = 16) -> bytes:
    h, w, n = a.shape
    v = _depth(a, (1 << bits) - 1, ">u2" if bits == 16 else "u1").tobytes()
    stride = w * n * bits // 8
    raw = b"".join(b"\0" + v[y * stride : (y + 1) * stride] for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: name -> (what its files begin with, decoder, encoder, the largest sample that it stores, 0: floating point)
FORMATS: dict[str, tuple[bytes, Callable, Callable, int]] = {
    "pbm": (b"P4", decode_pnm, encode_pbm, 1),
    "pgm": (b"P5", decode_pnm, _pnm("P5", 255), 255),
    "ppm": (b"P6", decode_pnm, _pnm("P6", 65535), 65535),
    "pgm_text": (b"P2", decode_pnm, _pnm("P2", 255), 255),
    "ppm_text": (b"P3", decode_pnm, _pnm("P3", 255), 255),
    "pam": (b"P7", decode_pnm, encode_pam, 65535),
    "pfm": (b"Pf", decode_pfm, encode_pfm, 0),
    "farbfeld": (b"farbfeld", decode_farbfeld, encode_farbfeld, 65535),
    "avs": (b"\0\0", decode_avs, encode_avs, 255),
    "txt": (b"# pixels", decode_txt, encode_txt, 65535),
    "xbm": (b"#define", decode_xbm, encode_xbm, 1),
    "bmp": (b"BM", decode_bmp, encode_bmp, 255),
    "qoi": (b"qoif", decode_qoi, encode_qoi, 255),
    "png": (b"\x89PNG", decode_png, encode_png, 65535),
}


def sniff(data: bytes) -> str | None:
    """The format by a file's first bytes."""
    if data[:2] in (b"P1", b"P4"):
        return "pbm"
    if data[:2] == b"PF":
        return "pfm"
    found = [name for name, (magic, *_) in FORMATS.items() if data.startswith(magic)]
    return max(found, key=lambda n: len(FORMATS[n][0]), default=None)


def packbits(data: bytes) -> bytes:
    """Runs as a negative count and a byte, the rest as a count and bytes."""
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
            at += n
            continue
        begin = at
        while at < len(data) and at - begin < 128 and not (at + 1 < len(data) and data[at] == data[at + 1]):
            at += 1
        out += bytes([at - begin - 1]) + data[begin:at]
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        elif n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> list[int]:
    """Codes 0 to 255 are bytes, 256 begins, 257 ends; the table starts anew at 4096."""
    table, out, held = {bytes([i]): i for i in range(256)}, [256], b""
    for b in data:
        c = bytes([b])
        if held + c in table:
            held += c
            continue
        out.append(table[held])
        table[held + c] = len(table) + 2
        if len(table) + 2 >= 4096:
            table = {bytes([i]): i for i in range(256)}
            out.append(256)
        held = c
    return out + ([table[held]] if held else []) + [257]


def unlzw(codes: list[int]) -> bytes:
    out, table, last = bytearray(), {}, b""
    for c in codes:
        if c == 256:
            table, last = {i: bytes([i]) for i in range(256)}, b""
            continue
        if c == 257:
            break
        entry = table[c] if c in table else last + last[:1]
        out += entry
        if last:
            table[len(table) + 2] = last + entry[:1]
        last = entry
    return bytes(out)
