"""Colour spaces as SQL over the channels r, g, b on the scale 0 to 1, D65 white, 2 degree observer.

``forward(space)`` gives three (or four) expressions; ``inverse(space)`` takes columns c0, c1, c2 back.
"""

from __future__ import annotations

from tessera.core import doubles

#: Fixed values of the standards: sRGB to XYZ, and the white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
#: Linear combinations of encoded r, g, b, with what is added to each.
LINEAR = {
    "cmy": (((-1, 0, 0), (0, -1, 0), (0, 0, -1)), (1, 1, 1)),
    "ohta": (((0.33333, 0.33334, 0.33333), (0.5, 0, -0.5), (-0.25, 0.5, -0.25)), (0, 0.5, 0.5)),
    "rec601ycbcr": (((0.298839, 0.586811, 0.114350), (-0.1687367, -0.331264, 0.5), (0.5, -0.418688, -0.081312)), (0, 0.5, 0.5)),
    "rec709ycbcr": (((0.212656, 0.715158, 0.072186), (-0.114572, -0.385428, 0.5), (0.5, -0.454153, -0.045847)), (0, 0.5, 0.5)),
    "yiq": (((0.298839, 0.586811, 0.114350), (0.595716, -0.274453, -0.321263), (0.211456, -0.522591, 0.311135)), (0, 0.5, 0.5)),
    "yuv": (((0.298839, 0.586811, 0.114350), (-0.147, -0.289, 0.436), (0.615, -0.515, -0.100)), (0, 0.5, 0.5)),
    "ypbpr": (((0.298839, 0.586811, 0.114350), (-0.1687367, -0.331264, 0.5), (0.5, -0.418688, -0.081312)), (0, 0.5, 0.5)),
    "ydbdr": (((0.298839, 0.586811, 0.114350), (-0.450, -0.883, 1.333), (-1.333, 1.116, 0.217)), (0, 0.5, 0.5)),
}
#: Linear light: matrices over XYZ.
CAT02 = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))
P3 = ((2.4934969, -0.9313836, -0.4027108), (-0.8294890, 1.7626641, 0.0236247), (0.0358458, -0.0761724, 0.9568845))
ADOBE = ((2.0413690, -0.5649464, -0.3446944), (-0.9692660, 1.8760108, 0.0415560), (0.0134474, -0.1183897, 1.0154096))
OKLAB_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
#: Grey intensities of r, g, b.
INTENSITY = {
    "average": "(r + g + b) / 3.0",
    "brightness": "greatest(r, g, b)",
    "lightness": "(least(r, g, b) + greatest(r, g, b)) / 2.0",
    "ms": "(r * r + g * g + b * b) / 3.0",
    "rms": "sqrt((r * r + g * g + b * b) / 3.0)",
    "rec601luma": "0.298839 * r + 0.586811 * g + 0.114350 * b",
    "rec709luma": "0.212656 * r + 0.715158 * g + 0.072186 * b",
}


def decode(c: str) -> str:
    """sRGB to linear light."""
    return f"(CASE WHEN {c} <= 0.0404482362771076 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"


def encode(c: str) -> str:
    """Linear light to sRGB."""
    return f"(CASE WHEN {c} <= 0.0031306684425005883 THEN 12.92 * {c} ELSE 1.055 * pow({c}, 1.0 / 2.4) - 0.055 END)"


INTENSITY["rec601luminance"] = f"0.298839 * {decode('r')} + 0.586811 * {decode('g')} + 0.114350 * {decode('b')}"
INTENSITY["rec709luminance"] = f"0.212656 * {decode('r')} + 0.715158 * {decode('g')} + 0.072186 * {decode('b')}"


def _apply(matrix: tuple, parts: tuple, plus: tuple = (0, 0, 0)) -> tuple[str, ...]:
    return tuple("(" + " + ".join(f"({float(m)!r}) * {p}" for m, p in zip(row, parts, strict=True)) + f" + ({float(a)!r}))" for row, a in zip(matrix, plus, strict=True))


def _inverse(m: tuple) -> tuple:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return tuple(tuple(x / det for x in row) for row in ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d)))


_RGB = ("r", "g", "b")
_LIGHT = tuple(map(decode, _RGB))
_MAX, _MIN = "greatest(r, g, b)", "least(r, g, b)"
_HUE = f"(CASE WHEN {_MAX} = {_MIN} THEN 0.0 WHEN r = {_MAX} THEN (CASE WHEN g < b THEN 1.0 ELSE 0.0 END) + (g - b) / (6.0 * ({_MAX} - {_MIN})) WHEN g = {_MAX} THEN 1.0 / 3.0 + (b - r) / (6.0 * ({_MAX} - {_MIN})) ELSE 2.0 / 3.0 + (r - g) / (6.0 * ({_MAX} - {_MIN})) END)"


def _cube(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856451679035631 THEN pow({t}, 1.0 / 3.0) ELSE (903.2962962962963 * {t} + 16.0) / 116.0 END)"


def _polar(first: str, a: str, b: str) -> tuple[str, str, str]:
    """Chroma and hue of a pair of opponent channels; a gray pixel has hue 0."""
    chroma = f"sqrt({a} * {a} + {b} * {b})"
    return first, chroma, f"(CASE WHEN {chroma} < 1.0e-6 THEN 0.0 WHEN atan2({b}, {a}) < 0 THEN atan2({b}, {a}) / (2.0 * pi()) + 1.0 ELSE atan2({b}, {a}) / (2.0 * pi()) END)"


def forward(space: str) -> tuple[str, ...]:
    """Expressions of the space's channels over r, g and b."""
    return tuple(map(doubles, _forward(space)))


def _forward(space: str) -> tuple[str, ...]:
    if space in LINEAR:
        matrix, plus = LINEAR[space]
        return _apply(matrix, _RGB, plus)
    if space in ("rgb", "scrgb"):
        return _LIGHT
    if space in ("gray", "lineargray"):
        y = f"({INTENSITY['rec709luma']})" if space == "gray" else f"({INTENSITY['rec709luminance']})"
        return y, y, y
    if space == "cmyk":
        k = f"(1.0 - {_MAX})"
        return (*(f"(CASE WHEN {_MAX} = 0 THEN 0.0 ELSE ({_MAX} - {c}) / {_MAX} END)" for c in _RGB), k)
    if space in ("hsv", "hsb"):
        return _HUE, f"(CASE WHEN {_MAX} = 0 THEN 0.0 ELSE ({_MAX} - {_MIN}) / {_MAX} END)", _MAX
    if space == "hsl":
        total = f"({_MAX} + {_MIN})"
        return _HUE, f"(CASE WHEN {_MAX} = {_MIN} THEN 0.0 WHEN {total} <= 1.0 THEN ({_MAX} - {_MIN}) / {total} ELSE ({_MAX} - {_MIN}) / (2.0 - {total}) END)", f"({total} / 2.0)"
    if space == "hwb":
        return _HUE, _MIN, f"(1.0 - {_MAX})"
    if space == "hcl":
        return _HUE, f"({_MAX} - {_MIN})", f"({INTENSITY['rec601luma']})"
    if space == "hsi":
        i = "((r + g + b) / 3.0)"
        alpha, beta = "(0.5 * (2.0 * r - g - b))", "(0.8660254037844385 * (g - b))"
        return f"(CASE WHEN {beta} < 0 THEN atan2({beta}, {alpha}) / (2.0 * pi()) + 1.0 ELSE atan2({beta}, {alpha}) / (2.0 * pi()) END)", f"(CASE WHEN {i} = 0 THEN 0.0 ELSE 1.0 - {_MIN} / {i} END)", i
    xyz = _apply(XYZ, _LIGHT)
    if space == "xyz":
        return xyz
    if space == "xyy":
        total = f"({' + '.join(xyz)})"
        safe = f"(CASE WHEN abs({total}) < 1.0e-12 THEN 1.0e12 ELSE 1.0 / {total} END)"
        return f"{xyz[0]} * {safe}", f"{xyz[1]} * {safe}", xyz[1]
    if space == "lms":
        return _apply(CAT02, xyz)
    if space in ("displayp3", "adobe98"):
        out = _apply(P3 if space == "displayp3" else ADOBE, xyz)
        return tuple(encode(c) if space == "displayp3" else f"(CASE WHEN {c} < 0 THEN -pow(-{c}, 1.0 / 2.19921875) ELSE pow({c}, 1.0 / 2.19921875) END)" for c in out)
    if space in ("lab", "lchab"):
        x, y, z = (_cube(f"({c} / {w!r})") for c, w in zip(xyz, WHITE, strict=True))
        lab = f"(1.16 * {y} - 0.16)", f"(5.0 * ({x} - {y}))", f"(2.0 * ({y} - {z}))"
        return lab if space == "lab" else _polar(*lab)
    if space in ("luv", "lchuv"):
        x, y, z = xyz
        lightness = f"(CASE WHEN {y} > 0.008856451679035631 THEN 116.0 * pow({y}, 1.0 / 3.0) - 16.0 ELSE 903.2962962962963 * {y} END)"
        total = f"({x} + 15.0 * {y} + 3.0 * {z})"
        safe = f"(CASE WHEN {total} < 1.0e-12 THEN 0.0 ELSE 1.0 / {total} END)"
        un, vn = 4 * WHITE[0] / (WHITE[0] + 15 + 3 * WHITE[2]), 9 / (WHITE[0] + 15 + 3 * WHITE[2])
        luv = f"({lightness} / 100.0)", f"(13.0 * {lightness} * (4.0 * {x} * {safe} - {un!r}) / 100.0)", f"(13.0 * {lightness} * (9.0 * {y} * {safe} - {vn!r}) / 100.0)"
        return luv if space == "luv" else _polar(*luv)
    if space in ("oklab", "oklch"):
        lms = tuple(f"cbrt({c})" for c in _apply(OKLAB_LMS, _LIGHT))
        lab = _apply(OKLAB, lms)
        return lab if space == "oklab" else _polar(*lab)
    raise ValueError(f"no colour space {space}")


SPACES = (*LINEAR, "rgb", "gray", "lineargray", "cmyk", "hsv", "hsl", "hwb", "hcl", "hsi", "xyz", "xyy", "lms", "displayp3", "adobe98", "lab", "lchab", "luv", "lchuv", "oklab", "oklch")


def inverse(space: str) -> tuple[str, str, str]:
    """Expressions of r, g and b over the space's channels c0, c1, c2, for the linear spaces, rgb, hsv, hsl, hwb, xyz and lab."""
    return tuple(map(doubles, _backward(space)))


def _backward(space: str) -> tuple[str, ...]:
    c = ("c0", "c1", "c2")
    if space in LINEAR:
        matrix, plus = LINEAR[space]
        return _apply(_inverse(matrix), tuple(f"({x} - ({float(p)!r}))" for x, p in zip(c, plus, strict=True)))
    if space == "rgb":
        return tuple(map(encode, c))
    if space in ("hsv", "hsl", "hwb"):
        high = {"hsv": "c2", "hwb": "(1.0 - c2)", "hsl": "(c2 + c1 * least(c2, 1.0 - c2))"}[space]
        low = {"hsv": "(c2 * (1.0 - c1))", "hwb": "c1", "hsl": "(c2 - c1 * least(c2, 1.0 - c2))"}[space]
        part = lambda k: f"(c0 * 6.0 + {k} - 6.0 * floor((c0 * 6.0 + {k}) / 6.0))"
        return tuple(f"({high} - ({high} - {low}) * greatest(0.0, least({part(k)}, 4.0 - {part(k)}, 1.0)))" for k in ("5.0", "3.0", "1.0"))
    if space == "xyz":
        return tuple(map(encode, _apply(_inverse(XYZ), c)))
    if space == "lab":
        y = "((c0 + 0.16) / 1.16)"
        back = lambda t: f"(CASE WHEN {t} > 0.20689655172413793 THEN {t} * {t} * {t} ELSE (116.0 * {t} - 16.0) / 903.2962962962963 END)"
        xyz = tuple(f"({w!r} * {back(t)})" for w, t in zip(WHITE, (f"({y} + c1 / 5.0)", y, f"({y} - c2 / 2.0)"), strict=True))
        return tuple(map(encode, _apply(_inverse(XYZ), xyz)))
    raise ValueError(f"no way back from {space}")
