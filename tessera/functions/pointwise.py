"""Functions of one sample: arithmetic, transfer curves and thresholds, as SQL templates over {v} and constants."""

from __future__ import annotations

from pyspark.sql import Column

from tessera.core import column, reciprocal

#: v on 0..QR and a constant c.
EVALUATE = {
    "abs": "abs({v} + {c})",
    "add": "{v} + {c}",
    "add_modulus": "({v} + {c}) - 65536.0 * floor(({v} + {c}) / 65536.0)",
    "and": "CAST(CAST(floor({v}) AS BIGINT) & CAST(floor({c} + 0.5) AS BIGINT) AS DOUBLE)",
    "cosine": "65535.0 * (0.5 * cos(2.0 * pi() * {v} / 65535.0 * {c}) + 0.5)",
    "divide": "{v} / CASE WHEN {c} = 0 THEN 1.0 ELSE {c} END",
    "exponential": "65535.0 * exp({c} * {v} / 65535.0)",
    "inverse_log": "65535.0 * pow({c} + 1.0, {v} / 65535.0 - 1.0) / {c}",
    "left_shift": "{v} * pow(2.0, floor({c}))",
    "log": "65535.0 * ln({c} * {v} / 65535.0 + 1.0) / ln({c} + 1.0)",
    "max": "greatest({v}, {c})",
    "mean": "{v} + {c}",
    "median": "{v} + {c}",
    "min": "least({v}, {c})",
    "multiply": "{v} * {c}",
    "or": "CAST(CAST(floor({v}) AS BIGINT) | CAST(floor({c} + 0.5) AS BIGINT) AS DOUBLE)",
    "pow": "CASE WHEN abs({c}) < 1.0e-12 THEN 0.0 WHEN {v} < 0 THEN -65535.0 * pow(-{v} / 65535.0, {c}) ELSE 65535.0 * pow({v} / 65535.0, {c}) END",
    "right_shift": "{v} / pow(2.0, floor({c}))",
    "root_mean_square": "{v} * {v} + {c}",
    "set": "{c} + 0.0 * {v}",
    "sine": "65535.0 * (0.5 * sin(2.0 * pi() * {v} / 65535.0 * {c}) + 0.5)",
    "subtract": "{v} - {c}",
    "sum": "{v} + {c}",
    "threshold": "CASE WHEN {v} <= {c} THEN 0.0 ELSE 65535.0 END",
    "threshold_black": "CASE WHEN {v} <= {c} THEN 0.0 ELSE {v} END",
    "threshold_white": "CASE WHEN {v} > {c} THEN 65535.0 ELSE {v} END",
    "xor": "CAST(xor(CAST(floor({v}) AS BIGINT), CAST(floor({c} + 0.5) AS BIGINT)) AS DOUBLE)",
}
_G = "CASE WHEN {x} < 0 THEN {x} ELSE pow({x}, {p}) END"


def _power(x: str, p: str) -> str:
    return _G.replace("{x}", f"({x})").replace("{p}", p)


#: Transfer curves; further constants by name.
CURVES = {
    "sinusoid": "65535.0 * ({amp} * sin(2.0 * pi() * ({freq} * {v} / 65535.0 + {phase} / 360.0)) + {bias})",
    "arcsin": "65535.0 * CASE WHEN 2.0 / {width} * ({v} / 65535.0 - {center}) <= -1 THEN {bias} - {range} / 2.0 WHEN 2.0 / {width} * ({v} / 65535.0 - {center}) >= 1 THEN {bias} + {range} / 2.0 ELSE {range} / pi() * asin(2.0 / {width} * ({v} / 65535.0 - {center})) + {bias} END",
    "arctan": "65535.0 * ({range} / pi() * atan(pi() * {slope} * ({v} / 65535.0 - {center})) + {bias})",
    "level": "65535.0 * (" + _power("({v} - {black}) * " + reciprocal("{white} - {black}"), "1.0 / {gamma}") + ")",
    "levelize": "pow({v} / 65535.0, 1.0 / {gamma}) * ({white} - {black}) + {black}",
    "gamma": "CASE WHEN {gamma} = 0 THEN 0.0 ELSE 65535.0 * pow(least(greatest(floor({v} + 0.5), 0.0), 65535.0) / 65535.0, 1.0 / {gamma}) END",
    "sigmoidal": "65535.0 * (tanh(0.5 * {contrast} * ({v} / 65535.0 - {mid})) - tanh(0.5 * {contrast} * (0.0 - {mid}))) / (tanh(0.5 * {contrast} * (1.0 - {mid})) - tanh(0.5 * {contrast} * (0.0 - {mid})))",
    "negate": "65535.0 - {v}",
    "solarize": "CASE WHEN {v} > {at} THEN 65535.0 - {v} ELSE {v} END",
    "clamp": "least(greatest({v}, 0.0), 65535.0)",
    "perceptible": "CASE WHEN abs({v}) >= {eps} THEN {v} WHEN {v} < 0 THEN -{eps} ELSE {eps} END",
    "bilevel": "CASE WHEN {v} <= {at} THEN 0.0 ELSE 65535.0 END",
    "black_threshold": "CASE WHEN {v} < {at} THEN 0.0 ELSE {v} END",
    "white_threshold": "CASE WHEN {v} > {at} THEN 65535.0 ELSE {v} END",
    "range_threshold": "CASE WHEN {v} < {lb} THEN 0.0 WHEN {v} < {lw} THEN 65535.0 * ({v} - {lb}) / ({lw} - {lb}) WHEN {v} <= {hw} THEN 65535.0 WHEN {v} <= {hb} THEN 65535.0 * ({hb} - {v}) / ({hb} - {hw}) ELSE 0.0 END",
    "posterize": "65535.0 * floor({v} / 65535.0 * ({levels} - 1.0) + 0.5) / greatest({levels} - 1.0, 1.0)",
    "depth": "floor({v} / 65535.0 * (pow(2.0, {bits}) - 1.0) + 0.5) / (pow(2.0, {bits}) - 1.0) * 65535.0",
    "colorize": "({v} * (100.0 - {blend}) + {fill} * {blend}) / 100.0",
    "tint": "{v} + {fill} * (1.0 - 4.0 * ({v} / 65535.0 - 0.5) * ({v} / 65535.0 - 0.5))",
}


def polynomial(v: str, terms: list[float]) -> str:
    """Horner's rule, highest order first, on the scale 0 to 1."""
    out = "0.0"
    for t in terms:
        out = f"({out} * {v} / 65535.0 + ({t!r}))"
    return f"65535.0 * {out}"


def brightness_contrast(v: str, brightness: float, contrast: float) -> str:
    slope = 0.01 * contrast + 1.0 if contrast < 0 else 100.0 / max(100.0 - contrast, 1e-12)
    return polynomial(v, [slope, (0.01 * brightness - 0.5) * slope + 0.5])


def evaluate(v: str, op: str, c: float) -> Column:
    """One of EVALUATE over a column."""
    return column(_spark(EVALUATE[op]), v=v, c=c)


def curve(v: str, name: str, **constants: float) -> Column:
    return column(CURVES[name], v=v, **constants)


def _spark(template: str) -> str:
    return template.replace("xor(CAST(floor({v}) AS BIGINT), CAST(floor({c} + 0.5) AS BIGINT))", "(CAST(floor({v}) AS BIGINT) ^ CAST(floor({c} + 0.5) AS BIGINT))")
