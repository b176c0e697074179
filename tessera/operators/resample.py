"""Resizing and warping: each output pixel gathers input pixels by an equi-join on a small table of taps per axis."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _sinc(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


def _cubic(b: float, c: float) -> Callable[[float], float]:
    def k(x: float) -> float:
        x = abs(x)
        if x < 1:
            return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
        return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6 if x < 2 else 0.0

    return k


def _windowed(window: Callable[[float], float], support: float) -> tuple[float, Callable[[float], float]]:
    return support, lambda x: _sinc(x) * window(abs(x) / support) if abs(x) < support else 0.0


#: Support and weight of each filter.
FILTERS: dict[str, tuple[float, Callable[[float], float]]] = {
    "point": (0.0, lambda x: 1.0),
    "box": (0.5, lambda x: 1.0),
    "triangle": (1.0, lambda x: max(0.0, 1 - abs(x))),
    "hermite": (1.0, lambda x: (2 * abs(x) - 3) * x * x + 1 if abs(x) < 1 else 0.0),
    "quadratic": (1.5, lambda x: 0.75 - x * x if abs(x) < 0.5 else 0.5 * (abs(x) - 1.5) ** 2 if abs(x) < 1.5 else 0.0),
    "gaussian": (2.0, lambda x: math.exp(-2 * x * x)),
    "spline": (2.0, _cubic(1, 0)),
    "catrom": (2.0, _cubic(0, 0.5)),
    "mitchell": (2.0, _cubic(1 / 3, 1 / 3)),
    "robidoux": (2.0, _cubic(0.37821575509399867, 0.31089212245300067)),
    "robidouxsharp": (2.0, _cubic(0.2620145123990142, 0.3689927438004929)),
    "lanczos": _windowed(_sinc, 3.0),
    "lanczos2": _windowed(_sinc, 2.0),
    "hann": _windowed(lambda x: 0.5 + 0.5 * math.cos(math.pi * x), 4.0),
    "hamming": _windowed(lambda x: 0.54 + 0.46 * math.cos(math.pi * x), 4.0),
    "blackman": _windowed(lambda x: 0.42 + 0.5 * math.cos(math.pi * x) + 0.08 * math.cos(2 * math.pi * x), 4.0),
    "bohman": _windowed(lambda x: (1 - x) * math.cos(math.pi * x) + math.sin(math.pi * x) / math.pi, 4.0),
    "bartlett": _windowed(lambda x: 1 - x, 4.0),
    "welch": _windowed(lambda x: 1 - x * x, 4.0),
    "cosine": _windowed(lambda x: math.cos(math.pi / 2 * x), 4.0),
    "parzen": _windowed(lambda x: 1 - 6 * x * x + 6 * x**3 if x < 0.5 else 2 * (1 - x) ** 3, 4.0),
    "sinc": (4.0, _sinc),
    "kaiser": _windowed(lambda x: float(np.i0(6.5 * math.sqrt(max(0.0, 1 - x * x))) / np.i0(6.5)), 4.0),
}


def taps(n: int, to: int, name: str) -> list[tuple[int, int, float]]:
    """(output, input, weight) along one axis; the weights of an output add up to 1."""
    support, weight = FILTERS[name]
    factor = to / n
    scale = max(1 / factor, 1.0)
    reach = max(scale * support, 0.5)
    out = []
    for o in range(to):
        centre = (o + 0.5) / factor + 1e-12
        start, stop = int(max(centre - reach + 0.5, 0)), int(min(centre + reach + 0.5, n))
        own = [(i, weight((i - centre + 0.5) / scale)) for i in range(start, stop)]
        total = sum(w for _, w in own)
        out += [(o, i, w / total) for i, w in own]
    return out


def _axis(df: DataFrame, axis: str, table: list[tuple[int, int, float]], key: str) -> DataFrame:
    """Sums the axis' pixels by the table's weights; the table rides along as a constant, by input."""
    by: dict[int, list[tuple[int, float]]] = {}
    for o, i, w in table:
        by.setdefault(i, []).append((o, w))
    cells = F.create_map(*(x for i, own in by.items() for x in (F.lit(i), F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in own)))))
    other = "x" if axis == "y" else "y"
    each = df.select(key, other, "v", F.explode(F.element_at(cells, F.col(axis))).alias("t"))
    return each.groupBy(key, other, F.col("t.o").alias(axis)).agg(F.sum(F.col("v") * F.col("t.w")).alias("v"))


def resize(df: DataFrame, height: int, width: int, to_height: int, to_width: int, name: str = "triangle", key: str = "image_id") -> DataFrame:
    """Images of one size to another, one axis after the other."""
    return _axis(_axis(df, "x", taps(width, to_width, name), key), "y", taps(height, to_height, name), key)


def sample(df: DataFrame, height: int, width: int, to_height: int, to_width: int, key: str = "image_id") -> DataFrame:
    """The nearest pixel: trunc((o + 0.5 - eps) n / to)."""
    table = lambda n, to: [(o, int((o + 0.5 - 1e-12) * n / to), 1.0) for o in range(to)]
    return _axis(_axis(df, "x", table(width, to_width), key), "y", table(height, to_height), key)


def scale(df: DataFrame, height: int, width: int, to_height: int, to_width: int, key: str = "image_id") -> DataFrame:
    """Averages by area."""

    def table(n: int, to: int) -> list[tuple[int, int, float]]:
        f = n / to
        return [(o, i, (min((o + 1) * f, i + 1) - max(o * f, i)) / f) for o in range(to) for i in range(int(o * f), min(n, math.ceil((o + 1) * f))) if min((o + 1) * f, i + 1) > max(o * f, i)]

    return _axis(_axis(df, "x", table(width, to_width), key), "y", table(height, to_height), key)


def distort(df: DataFrame, height: int, width: int, y: str, x: str, background: float = 0.0, key: str = "image_id") -> DataFrame:
    """Each output pixel from the four around the place (y, x) that the expressions give for it; the background outside."""
    grid = df.select(key, "y", "x").withColumns({"sy": F.expr(y), "sx": F.expr(x)})
    four = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    at = grid.select("*", F.explode(four).alias("t")).withColumns({"iy": F.floor("sy") + F.col("t.a"), "ix": F.floor("sx") + F.col("t.b")})
    w = (1 - F.abs(F.col("sy") - F.col("iy"))) * (1 - F.abs(F.col("sx") - F.col("ix")))
    there = df.select(key, F.col("y").cast("long").alias("iy"), F.col("x").cast("long").alias("ix"), F.col("v").alias("s"))
    met = at.withColumn("w", w).join(there, [key, "iy", "ix"], "left")
    return met.groupBy(key, "y", "x").agg(F.sum(F.col("w") * F.coalesce("s", F.lit(background))).alias("v"))


def affine(height: int, width: int, degrees: float, zoom: float = 1.0) -> tuple[str, str]:
    """Inverse map of a turn and a zoom about the middle, for distort()."""
    c, s = math.cos(math.radians(degrees)) / zoom, math.sin(math.radians(degrees)) / zoom
    cy, cx = (height - 1) / 2, (width - 1) / 2
    return f"{cy}D + ({-s}D) * (x - {cx}D) + ({c}D) * (y - {cy}D)", f"{cx}D + ({c}D) * (x - {cx}D) + ({s}D) * (y - {cy}D)"


def wave(amplitude: float, length: float) -> tuple[str, str]:
    return f"y - {amplitude}D * sin(2D * pi() * x / {length}D)", "cast(x as double)"


def swirl(height: int, width: int, degrees: float) -> tuple[str, str]:
    cy, cx, r = (height - 1) / 2, (width - 1) / 2, max(height, width) / 2
    d = f"sqrt((x - {cx}D) * (x - {cx}D) + (y - {cy}D) * (y - {cy}D))"
    a = f"({math.radians(degrees)}D * pow(greatest(0D, 1D - {d} / {r}D), 2D))"
    return f"{cy}D + sin({a}) * (x - {cx}D) + cos({a}) * (y - {cy}D)", f"{cx}D + cos({a}) * (x - {cx}D) - sin({a}) * (y - {cy}D)"


def implode(height: int, width: int, amount: float) -> tuple[str, str]:
    cy, cx, r = (height - 1) / 2, (width - 1) / 2, max(height, width) / 2
    d = f"((x - {cx}D) * (x - {cx}D) + (y - {cy}D) * (y - {cy}D))"
    f = f"(CASE WHEN {d} >= {r * r}D OR {d} = 0 THEN 1D ELSE pow(sin(pi() * sqrt({d}) / {r}D / 2D), {-amount}D) END)"
    return f"{cy}D + {f} * (y - {cy}D)", f"{cx}D + {f} * (x - {cx}D)"


def sparse_color(grid: DataFrame, points: list[tuple[float, float, float]], method: str = "shepards") -> DataFrame:
    """v of each pixel from a few points (x, y, v): shepards weighs by inverse squared distance, inverse by distance, voronoi takes the nearest, manhattan the nearest along the axes."""
    d2 = [(F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py) for px, py, _ in points]
    if method in ("voronoi", "manhattan"):
        far = d2 if method == "voronoi" else [F.abs(F.col("x") - px) + F.abs(F.col("y") - py) for px, py, _ in points]
        return grid.withColumn("v", F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(p[2]).alias("v")) for i, (d, p) in enumerate(zip(far, points, strict=True)))))["v"])
    w = [1.0 / F.greatest(d if method == "shepards" else F.sqrt(d), F.lit(1e-12)) for d in d2]
    top, bottom = w[0] * points[0][2], w[0]
    for k, p in zip(w[1:], points[1:], strict=True):
        top, bottom = top + k * p[2], bottom + k
    return grid.withColumn("v", top / bottom)
