"""Blends of a source pixel (sc, sa) over a canvas pixel (dc, da), all on the scale 0 to 1.

Names in the templates: S and D are the premultiplied colours, s and d the plain ones, Sa and Da the alphas.
Each entry gives the resulting alpha and the resulting premultiplied colour; where the alpha is 0 the colour is 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import formula

_UNION = "Sa + Da - Sa * Da"
_KEEP = "S * (1.0 - Da) + D * (1.0 - Sa)"


def _math(body: str) -> tuple[str, str]:
    """A blend where both cover, each alone where it covers alone."""
    return _UNION, f"Sa * Da * ({body}) + {_KEEP}"


BLENDS = {
    "over": (_UNION, "S + D * (1.0 - Sa)"),
    "dst_over": (_UNION, "D + S * (1.0 - Da)"),
    "in": ("Sa * Da", "S * Da"),
    "dst_in": ("Sa * Da", "D * Sa"),
    "out": ("Sa * (1.0 - Da)", "S * (1.0 - Da)"),
    "dst_out": ("Da * (1.0 - Sa)", "D * (1.0 - Sa)"),
    "atop": ("Da", "S * Da + D * (1.0 - Sa)"),
    "dst_atop": ("Sa", "D * Sa + S * (1.0 - Da)"),
    "xor": ("Sa + Da - 2.0 * Sa * Da", _KEEP),
    "clear": ("0.0", "0.0"),
    "copy": ("Sa", "S"),
    "dst": ("Da", "D"),
    "plus": ("least(1.0, Sa + Da)", "S + D"),
    "multiply": _math("s * d"),
    "screen": _math("s + d - s * d"),
    "overlay": _math("CASE WHEN 2.0 * d <= 1.0 THEN 2.0 * s * d ELSE 1.0 - 2.0 * (1.0 - s) * (1.0 - d) END"),
    "hard_light": _math("CASE WHEN s <= 0.5 THEN 2.0 * s * d ELSE 1.0 - 2.0 * (1.0 - s) * (1.0 - d) END"),
    "soft_light": _math("CASE WHEN s <= 0.5 THEN d - (1.0 - 2.0 * s) * d * (1.0 - d) WHEN d <= 0.25 THEN d + (2.0 * s - 1.0) * (((16.0 * d - 12.0) * d + 4.0) * d - d) ELSE d + (2.0 * s - 1.0) * (sqrt(greatest(d, 0.0)) - d) END"),
    "pegtop_light": _math("d * d * (1.0 - 2.0 * s) + 2.0 * s * d"),
    "darken": _math("least(s, d)"),
    "lighten": _math("greatest(s, d)"),
    "difference": _math("abs(s - d)"),
    "exclusion": _math("s + d - 2.0 * s * d"),
    "color_burn": _math("CASE WHEN d >= 1.0 THEN 1.0 WHEN s <= 0 THEN 0.0 ELSE 1.0 - least(1.0, (1.0 - d) / s) END"),
    "color_dodge": _math("CASE WHEN d <= 0 THEN 0.0 WHEN s >= 1.0 THEN 1.0 ELSE least(1.0, d / (1.0 - s)) END"),
    "linear_burn": _math("s + d - 1.0"),
    "linear_dodge": _math("s + d"),
    "linear_light": _math("d + 2.0 * s - 1.0"),
    "vivid_light": _math("CASE WHEN s <= 0 THEN 0.0 WHEN s >= 1.0 THEN 1.0 WHEN s <= 0.5 THEN 1.0 - (1.0 - d) / (2.0 * s) ELSE d / (2.0 * (1.0 - s)) END"),
    "pin_light": _math("CASE WHEN s <= 0.5 THEN least(d, 2.0 * s) ELSE greatest(d, 2.0 * s - 1.0) END"),
    "hard_mix": _math("CASE WHEN s + d < 1.0 THEN 0.0 ELSE 1.0 END"),
    "negate": _math("1.0 - abs(1.0 - s - d)"),
    "reflect": _math("CASE WHEN d >= 1.0 THEN 1.0 ELSE least(1.0, s * s / (1.0 - d)) END"),
    "freeze": _math("CASE WHEN d <= 0 THEN 0.0 ELSE greatest(0.0, 1.0 - (1.0 - s) * (1.0 - s) / d) END"),
    "interpolate": _math("0.5 - 0.25 * cos(pi() * s) - 0.25 * cos(pi() * d)"),
    "stamp": _math("s + d - 1.0"),
    "soft_burn": _math("CASE WHEN s <= 0 THEN 0.0 ELSE 1.0 - least(1.0, (1.0 - d) / s) END"),
    "soft_dodge": _math("CASE WHEN s >= 1.0 THEN 1.0 ELSE least(1.0, d / (1.0 - s)) END"),
    "modulus_add": _math("s + d - floor(s + d)"),
    "modulus_subtract": _math("s - d - floor(s - d)"),
    "minus_src": _math("s - d"),
    "minus_dst": _math("d - s"),
    "divide_src": _math("CASE WHEN abs(s) < 1.0e-12 THEN 1.0 ELSE d / s END"),
    "divide_dst": _math("CASE WHEN abs(d) < 1.0e-12 THEN 1.0 ELSE s / d END"),
    "mathematics": _math("0.5 * s * d + 0.25 * s + 0.25 * d + 0.1"),
    "threshold": _math("CASE WHEN abs(2.0 * (s - d)) < 0.3 THEN d ELSE d + (s - d) * 0.5 END"),
    "blend": ("least(1.0, 0.3 * Sa + 0.7 * Da)", "0.3 * S + 0.7 * D"),
    "dissolve": ("0.3 * Sa + Da - 0.3 * Sa * Da", "0.3 * S + D * (1.0 - 0.3 * Sa)"),
    "bumpmap": ("Da", "s * D"),
    "copy_alpha": ("Sa", "d * Sa"),
}


def blended(op: str) -> tuple[str, str]:
    """SQL of the plain colour and the alpha that a blend makes of columns sc, sa, dc and da."""
    names = {"Sa": "sa", "Da": "da", "S": "(sa * sc)", "D": "(da * dc)", "s": "sc", "d": "dc"}
    alpha, body = (re.sub(r"\b(Sa|Da|S|D|s|d)\b", lambda m: names[m[0]], t) for t in BLENDS[op])
    colour = f"CASE WHEN abs({alpha}) < 1.0e-12 THEN 0.0 ELSE ({body}) / ({alpha}) END"
    return formula(colour), formula(alpha)


def composite(pairs: DataFrame, op: str) -> DataFrame:
    """``pairs`` with columns c and a: the source over the canvas, pixel by pixel."""
    colour, alpha = blended(op)
    return pairs.withColumns({"c": F.expr(colour), "a": F.expr(alpha)})


#: Blends of whole colours: which of hue, chroma and luma come from the source.
_FROM_SOURCE = {"hue": "h", "saturate": "c", "luminize": "l", "colorize": "hc"}
_COPIES = {"copy_red": "r", "copy_cyan": "r", "copy_green": "g", "copy_magenta": "g", "copy_blue": "b", "copy_yellow": "b"}
COLOUR_BLENDS = (*_FROM_SOURCE, *_COPIES, "modulate", "lighten_intensity", "rmse", "change_mask")
_LUMA = dict(zip("rgb", (0.298839, 0.586811, 0.114350), strict=True))


def _hcl(p: str) -> dict[str, Column]:
    """Hue, chroma and luma of columns pr, pg, pb; a gray has hue 0."""
    r, g, b = (F.col(p + c) for c in "rgb")
    high, c = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    turn = F.when(r == high, (g - b) / c).when(g == high, (b - r) / c + 2.0).otherwise((r - g) / c + 4.0) / 6.0
    return {"h": F.when(c < 1.0e-12, 0.0).otherwise(turn), "c": c, "l": sum(F.col(p + k) * w for k, w in _LUMA.items())}


def _from_hcl(h: Column, c: Column, luma: Column) -> dict[str, Column]:
    """The colour of a hue at full strength c, shifted to the luma."""
    part = lambda k: (h * 6.0 + k) - 6.0 * F.floor((h * 6.0 + k) / 6.0)
    full = {n: c - c * F.greatest(F.lit(0.0), F.least(part(k), 4.0 - part(k), F.lit(1.0))) for n, k in (("r", 5.0), ("g", 3.0), ("b", 1.0))}
    shift = luma - sum(full[n] * w for n, w in _LUMA.items())
    return {n: v + shift for n, v in full.items()}


def _intensity(p: str) -> Column:
    return 0.212656 * F.col(p + "r") + 0.715158 * F.col(p + "g") + 0.072186 * F.col(p + "b")


def composite_colour(pairs: DataFrame, op: str, percent_luma: float = 100.0, percent_chroma: float = 100.0) -> DataFrame:
    """``pairs`` with r, g, b, a: a source colour (sr, sg, sb, sa) over a canvas colour (dr, dg, db, da), on the scale 0 to 1.

    Where one of the two is transparent the other one stands, for ``modulate`` the canvas. Hue, chroma and luma are
    those of HCL. ``modulate`` moves the canvas's luma by the source's intensity less one half, in whole steps of the
    scale 0 to 65535; ``change_mask`` makes pixels transparent that equal the source.
    """
    canvas, source = _hcl("d"), _hcl("s")
    d, s = ({c: F.col(p + c) for c in "rgb"} for p in "ds")
    alpha = F.col("sa") + F.col("da") - F.col("sa") * F.col("da")
    if op in _FROM_SOURCE:
        made = _from_hcl(*((source if k in _FROM_SOURCE[op] else canvas)[k] for k in "hcl"))
    elif op in _COPIES:
        return pairs.withColumns({c: (s if c == _COPIES[op] else d)[c] for c in "rgb"} | {"a": F.col("da")})
    elif op == "modulate":
        offset = (_intensity("s") * 65535.0 - 32768.0).cast("long")
        moved = _from_hcl(canvas["h"], canvas["c"] * (0.01 * percent_chroma), canvas["l"] + 0.01 * percent_luma * offset / 32768.0)
        made = {c: F.when((offset == 0) | (F.col("sa") < 1.0e-12), d[c]).otherwise(moved[c]) for c in "rgb"}
        return pairs.withColumns(made | {"a": F.col("da")})
    elif op == "lighten_intensity":
        made = {c: F.when(_intensity("s") > _intensity("d"), s[c]).otherwise(d[c]) for c in "rgb"}
    elif op == "rmse":
        far = {c: (F.col("d" + c) - F.col("s" + c)) * (F.col("d" + c) - F.col("s" + c)) for c in "rgb"}
        made = dict.fromkeys("rgb", F.sqrt(far["r"] + far["g"] + far["b"] / 3.0))
    elif op == "change_mask":
        same = (F.col("sr") == F.col("dr")) & (F.col("sg") == F.col("dg")) & (F.col("sb") == F.col("db"))
        return pairs.withColumns(d | {"a": F.when(same, 0.0).otherwise(F.col("da"))})
    else:
        raise ValueError(f"no blend of colours {op}")
    return pairs.withColumns({c: F.when(F.col("sa") < 1.0e-12, d[c]).when(F.col("da") < 1.0e-12, s[c]).otherwise(made[c]) for c in "rgb"} | {"a": alpha})
