"""Neighbourhoods. Edges repeat the outermost pixel.

All run as two window passes over rows and columns, in which a pixel stays one row: extremes of rectangles, and of what rectangles
around the pixel make up, means and Gaussians by themselves; other kernels and statistics over the samples that near() puts beside a pixel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .geometry import sizes


def _along(v: str, d: int, along: str, across: str, size: str, key: str) -> Column:
    """The value d pixels further along a line; beyond its ends that of the image's edge. Null where there is no pixel."""
    if not d:
        return F.col(v)
    line = W.partitionBy(key, across).orderBy(along)
    edge = F.lit(0) if d < 0 else F.col(size) - 1
    last = F.first(F.when(F.col(along) == edge, F.col(v)), ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return F.when(F.col(along) + d < 0 if d < 0 else F.col(along) + d > edge, last).otherwise(F.first(v).over(line.rangeBetween(d, d)))


def _bridged(df: DataFrame, v: str, along: str, reach: tuple[int, int], key: str) -> DataFrame:
    """The pixels with h, w and here, and where a line has a gap, rows without a sample (here is false) as far as the reach back and ahead, so that what a first pass finds there is met by the second. Whole images get none."""
    across, size = {"x": ("y", "w"), "y": ("x", "h")}[along]
    df = sizes(df.select(key, "y", "x", v), key).repartition(key, across)  # else sizes() may leave all of an image in one task
    line, at = W.partitionBy(key, across).orderBy(along), F.col(along)
    first = F.least(at, F.greatest(F.coalesce(F.lag(along).over(line) + reach[0] + 1, F.lit(0)), at - reach[1]))
    last = F.greatest(at, F.least(F.coalesce(F.lead(along).over(line), F.col(size)) - 1, at + reach[0]))
    df = df.withColumns({"first": first, "last": last}).withColumn("place", F.explode(F.sequence("first", "last")))
    return df.select(key, across, F.col("place").alias(along), "h", "w", (F.col("place") == at).alias("here"), F.when(F.col("place") == at, F.col(v)).alias(v))


def near(df: DataFrame, offsets: list[tuple], v: str = "v", key: str = "image_id") -> tuple[DataFrame, list[Column]]:
    """The pixels, and per offset (dy, dx, ...) the sample there as a struct of n, null where the image has no pixel.

    A pixel is one row in both passes: the first puts the samples of its row beside it, the second these lists of
    the rows above and below. Pixels with no neighbour at any offset are left out.
    """
    ys, xs = (sorted({o[i] for o in offsets}) for i in (0, 1))
    df = _bridged(df.select(key, "y", "x", F.struct(F.col(v).alias("n")).alias("p")), "p", "x", (max(0, -xs[0]), max(0, xs[-1])) if any(ys) else (0, 0), key)
    df = df.select(key, "y", "x", "h", "here", F.array(*(_along("p", dx, "x", "y", "w", key) for dx in xs)).alias("p"))
    df = df.select(key, "y", "x", "here", *(_along("p", dy, "y", "x", "h", key).alias(f"p{i}") for i, dy in enumerate(ys))).where("here")
    found = [F.get(F.col(f"p{ys.index(o[0])}"), F.lit(xs.index(o[1]))) for o in offsets]
    return df if (0, 0) in {o[:2] for o in offsets} else df.where(F.coalesce(*found).isNotNull()), found


def _sum(samples: list[Column], weights: list[float]) -> Column:
    """The weighted sum of those that there are."""
    total = F.lit(0.0)
    for p, k in zip(samples, weights, strict=True):
        total = total + F.coalesce(p["n"] * k, F.lit(0.0))
    return F.when(F.coalesce(*(p["n"] for p in samples)).isNotNull(), total)


def _best(columns: list[Column], kind: str) -> Column:
    """The least (min) or largest (max) of columns."""
    return columns[0] if len(columns) == 1 else {"min": F.least, "max": F.greatest}[kind](*columns)


def rectangle(width: int, height: int) -> list[tuple[int, int, float]]:
    return [(dy, dx, 1.0) for dy in range(-(height // 2), height - height // 2) for dx in range(-(width // 2), width - width // 2)]


#: Sliding statistics over the sorted samples s of a window; of nonpeak the median m, or where that is the least or the largest, the next one inwards.
STATISTICS = {
    "rms": "sqrt(aggregate(s, 0D, (t, e) -> t + e * e) / nullif(size(s), 0))",
    "standard_deviation": "transform(array(aggregate(s, 0D, (t, e) -> t + e) / nullif(size(s), 0)), m -> sqrt(aggregate(s, 0D, (t, e) -> t + (e - m) * (e - m)) / nullif(size(s), 0)))[0]",
    "median": "get(s, int(size(s) div 2))",
    "nonpeak": "transform(array(get(s, int(size(s) div 2))), m -> CASE WHEN m = s[0] THEN coalesce(array_min(filter(s, e -> e > m)), m) WHEN m = s[size(s) - 1] THEN coalesce(array_max(filter(s, e -> e < m)), m) ELSE m END)[0]",
}


def _mode(s: Column) -> Column:
    """The most frequent of samples that fall, of equals the least: the last of the longest runs."""

    def step(t: Column, e: Column) -> Column:
        run = F.when(e.eqNullSafe(t["of"]), t["run"] + 1).otherwise(1)
        return F.struct(F.when((run > t["c"]) | ((run == t["c"]) & e.isNotNull()), e).otherwise(t["v"]).alias("v"), F.greatest(run, t["c"]).alias("c"), run.alias("run"), e.alias("of"))

    none = F.lit(None).cast("double")
    return F.aggregate(s, F.struct(none.alias("v"), F.lit(0).alias("c"), F.lit(0).alias("run"), none.alias("of")), step, lambda t: t["v"])


def passes(df: DataFrame, kind: str, rectangles: list[tuple[int, int, int, int]], key: str = "image_id", rows_first: bool = True, gaps: bool = False) -> DataFrame:
    """Least (min) or largest (max) samples of rectangles (up, down, left, right) around each pixel, as windows over rows and windows over columns. An edge repeats its pixels, which an extreme doesn't count twice. gaps: images may lack pixels."""

    def over(v: str, along: str, across: str, reach: tuple[int, int]) -> Column:
        return {"min": F.min, "max": F.max}[kind](v).over(W.partitionBy(key, across).orderBy(along).rangeBetween(-reach[0], reach[1])) if any(reach) else F.col(v)

    (a, first), (b, second) = (("x", [r[2:] for r in rectangles]), ("y", [r[:2] for r in rectangles]))[:: 1 if rows_first else -1]
    reaches = sorted(set(first))
    df = _bridged(df, "v", a, tuple(map(max, zip(*first, strict=True))), key) if gaps else df.withColumn("here", F.lit(True))
    df = df.select(key, "y", "x", "here", *(over("v", a, b, r).alias(f"v{i}") for i, r in enumerate(reaches)))
    return df.select(key, "y", "x", "here", _best([over(f"v{reaches.index(p)}", b, a, q) for p, q in zip(first, second, strict=True)], kind).alias("v")).where("here").drop("here")


def _box(df: DataFrame, width: int, height: int, key: str) -> DataFrame:
    """Means of width x height windows: lags and leads along rows, then along columns; edges repeat."""
    out = df.select(key, "y", "x", "v")
    for along, across, size in (("x", "y", width), ("y", "x", height)):
        w = W.partitionBy(key, across).orderBy(along)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        total = F.col("v")
        for i in range(-(size // 2), size - size // 2):
            if i:
                total = total + (F.coalesce(F.lag("v", -i).over(w), F.first("v").over(whole)) if i < 0 else F.coalesce(F.lead("v", i).over(w), F.last("v").over(whole)))
        out = out.withColumn("v", total)
    return out.withColumn("v", F.col("v") / float(width * height))


def statistic(df: DataFrame, name: str, width: int = 3, height: int = 3, key: str = "image_id") -> DataFrame:
    """One of STATISTICS over width x height windows; mode is the most frequent sample, the lowest of equals."""
    reach = [(height // 2, height - height // 2 - 1, width // 2, width - width // 2 - 1)]
    if name in ("minimum", "maximum"):
        return passes(df, name[:3], reach, key)
    if name in ("gradient", "contrast"):
        low, high = passes(df, "min", reach, key).withColumnRenamed("v", "low"), passes(df, "max", reach, key).withColumnRenamed("v", "high")
        spread = F.col("high") - F.col("low")
        return low.join(high, [key, "y", "x"]).select(key, "y", "x", F.abs(spread if name == "gradient" else spread / F.greatest(F.col("high") + F.col("low"), F.lit(1.0e-12))).alias("v"))
    if name == "mean":
        return _box(df, width, height, key)
    pixels, samples = near(df, rectangle(width, height), key=key)
    if name == "mode":  # a null counts as a sample, a place without a pixel doesn't
        here = F.transform(F.filter(F.array(*samples), lambda p: p.isNotNull()), lambda p: p["n"])
        return pixels.select(key, "y", "x", _mode(F.sort_array(here, asc=False)).alias("v"))
    return pixels.select(key, "y", "x", F.sort_array(F.array_compact(F.array(*(p["n"] for p in samples)))).alias("s")).select(key, "y", "x", F.expr(STATISTICS[name]).alias("v"))


def convolve(df: DataFrame, kernel: list[list[float]], key: str = "image_id") -> DataFrame:
    """The weighted sum of the neighbours, the kernel reflected about its middle."""
    h, w = len(kernel), len(kernel[0])
    cells = [(h // 2 - i, w // 2 - j, kernel[i][j]) for i in range(h) for j in range(w) if kernel[i][j]]
    pixels, samples = near(df, cells, key=key)
    return pixels.select(key, "y", "x", _sum(samples, [k for _, _, k in cells]).alias("v"))


def gaussian(radius: int, sigma: float) -> list[float]:
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(k) for x in k]


def blur(df: DataFrame, radius: int = 1, sigma: float = 1.0, key: str = "image_id") -> DataFrame:
    """A Gaussian as two passes of lags and leads, one along rows and one along columns."""
    kernel = gaussian(radius, sigma)
    out = sizes(df, key)
    for along, across in (("x", "y"), ("y", "x")):
        w = W.partitionBy(key, across).orderBy(along)
        ends = F.first("v").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last("v").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        parts = [F.lit(k) * (F.coalesce(F.lag("v", -i).over(w), ends[0]) if i < 0 else F.coalesce(F.lead("v", i).over(w), ends[1]) if i else F.col("v")) for i, k in zip(range(-radius, radius + 1), kernel, strict=True)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        out = out.withColumn("v", total)
    return out.drop("h", "w")


def unsharp(df: DataFrame, radius: int = 1, sigma: float = 1.0, gain: float = 1.0, threshold: float = 0.05, key: str = "image_id") -> DataFrame:
    """v + gain (v - blur) where that difference is beyond the threshold."""
    soft = blur(df, radius, sigma, key).withColumnRenamed("v", "soft")
    d = F.col("v") - F.col("soft")
    return df.join(soft, [key, "y", "x"]).withColumn("v", F.when(F.abs(d) * 2 < threshold * 65535.0, F.col("v")).otherwise(F.col("v") + gain * d)).drop("soft")


def _rectangles(cells: list[tuple[int, int, float]]) -> list[tuple[int, int, int, int]] | None:
    """The rectangles (up, down, left, right) around the pixel that together are the cells, none within another; None if there are no such."""
    there = {c[:2] for c in cells}
    span = lambda d: range(min(0, d), max(0, d) + 1)
    if not there or any((y, x) not in there for dy, dx in there for y in span(dy) for x in span(dx)):
        return None
    reach = {dy: (-min(x for y, x in there if y == dy), max(x for y, x in there if y == dy)) for dy, _ in there}
    found = {(u, d, *(min(reach[y][i] for y in range(-u, d + 1)) for i in (0, 1))) for u in range(1 - min(reach)) for d in range(max(reach) + 1)}
    return sorted(r for r in found if not any(r != o and all(a <= b for a, b in zip(r, o, strict=True)) for o in found))


def _extreme(df: DataFrame, kind: str, cells: list[tuple[int, int, float]], key: str, rows_first: bool, gaps: bool) -> DataFrame:
    rectangles = _rectangles(cells)
    if rectangles:
        return passes(df, kind, rectangles, key, rows_first, gaps or len(rectangles) > 1)
    pixels, samples = near(df, cells, key=key)
    return pixels.select(key, "y", "x", _best([p["n"] for p in samples], kind).alias("v"))


def dilate(df: DataFrame, cells: list[tuple[int, int, float]], key: str = "image_id", gaps: bool = False) -> DataFrame:
    """Columns before rows, so that after erode() no shuffle comes between their passes over columns. gaps: one rectangle looks beyond missing pixels too, as other cells always do."""
    return _extreme(df, "max", [(-dy, -dx, k) for dy, dx, k in cells if k > 0.5], key, False, gaps)


def erode(df: DataFrame, cells: list[tuple[int, int, float]], key: str = "image_id", gaps: bool = False) -> DataFrame:
    return _extreme(df, "min", [c for c in cells if c[2] >= 0.5], key, True, gaps)


#: Small structuring elements: (dy, dx, 1).
SHAPES = {
    "square": rectangle(3, 3),
    "plus": [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (0, -1, 1.0), (-1, 0, 1.0)],
    "cross": [(0, 0, 1.0), (1, 1, 1.0), (1, -1, 1.0), (-1, 1, 1.0), (-1, -1, 1.0)],
    "line": [(0, -1, 1.0), (0, 0, 1.0), (0, 1, 1.0)],
}


def _ball(radius: float, inside) -> list[tuple[int, int, float]]:
    r = int(radius)
    return [(dy, dx, 1.0) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if inside(abs(dy), abs(dx))]


def diamond(radius: int) -> list[tuple[int, int, float]]:
    return _ball(radius, lambda a, b: a + b <= radius)


def disk(radius: float) -> list[tuple[int, int, float]]:
    return _ball(radius, lambda a, b: a * a + b * b <= radius * radius)


def octagon(radius: int) -> list[tuple[int, int, float]]:
    return _ball(radius, lambda a, b: a + b <= radius + radius // 2)


def ring(inner: float, outer: float) -> list[tuple[int, int, float]]:
    return _ball(outer, lambda a, b: inner * inner < a * a + b * b <= outer * outer)


SHAPES |= {"diamond": diamond(2), "disk": disk(2.5), "octagon": octagon(2), "ring": ring(1.0, 2.5)}
#: Patterns of set (1) and unset (0) neighbours; None is any.
PATTERNS = {
    "diagonals": [[0, 0, 0], [0, None, 1], [1, 1, None]],
    "line_ends": [[0, 0, None], [0, 1, 1], [0, 0, None]],
    "line_junctions": [[1, None, 1], [None, 1, None], [None, 1, None]],
    "ridges": [[0, 1, 0]],
}


def turned(pattern: list[list]) -> list[list[list]]:
    """A pattern and its quarter turns."""
    out = [pattern]
    for _ in range(3):
        out.append([list(row) for row in zip(*out[-1][::-1], strict=True)])
    return out


def hit_and_miss(df: DataFrame, patterns: list[list[list]], key: str = "image_id") -> DataFrame:
    """How far the least of a pattern's set neighbours is above the largest of its unset ones, 0 at least; of several patterns the largest."""
    offsets = [[(i - len(p) // 2, j - len(p[0]) // 2, c) for i, row in enumerate(p) for j, c in enumerate(row) if c is not None] for p in patterns]
    cells = sorted({c[:2] for o in offsets for c in o})
    pixels, samples = near(df, cells, key=key)

    def side(offset: list[tuple], value: int, kind: str, without: float) -> Column:
        return F.coalesce(*([_best(own, kind)] if (own := [samples[cells.index(c[:2])]["n"] for c in offset if c[2] == value]) else []), F.lit(without))

    fits = [side(o, 1, "min", 65535.0) - side(o, 0, "max", 0.0) for o in offsets]
    return pixels.select(key, "y", "x", F.greatest(F.lit(0.0), F.lit(0.0), *fits).alias("v"))


def thinned(df: DataFrame, patterns: list[list[list]], thicken: bool = False, key: str = "image_id") -> DataFrame:
    """A pass for each pattern in turn: what fits it is taken from the samples, or added to them."""
    for p in patterns:
        fit = hit_and_miss(df, [p], key).withColumnRenamed("v", "fit")
        df = df.join(fit, [key, "y", "x"]).withColumn("v", F.col("v") + F.col("fit") if thicken else F.col("v") - F.col("fit")).drop("fit")
    return df


def by_intensity(df: DataFrame, method: str, shape: str = "square", key: str = "image_id") -> DataFrame:
    """dilate, erode, open, close by whole pixels: the neighbour whose luma of r, g, b is the largest or least replaces the pixel. Of equal ones the largest or least colour."""
    for step in {"dilate": (dilate,), "erode": (erode,), "open": (erode, dilate), "close": (dilate, erode)}[method]:
        luma = 0.212656 * F.col("r") + 0.715158 * F.col("g") + 0.072186 * F.col("b")
        df = step(df.select(key, "y", "x", F.struct(luma.alias("i"), "r", "g", "b").alias("v")), SHAPES[shape], key, gaps=True).select(key, "y", "x", "v.r", "v.g", "v.b")
    return df


def morphology(df: DataFrame, method: str, shape: str = "square", key: str = "image_id") -> DataFrame:
    """dilate, erode, open, close, smooth, and the differences edge_in, edge_out, edge, top_hat, bottom_hat."""
    cells = SHAPES[shape]
    d, e = (lambda x: dilate(x, cells, key)), (lambda x: erode(x, cells, key))
    opened, closed = (lambda x: d(e(x))), (lambda x: e(d(x)))
    plain = {"dilate": d, "erode": e, "open": opened, "close": closed, "smooth": lambda x: closed(opened(x))}
    if method in plain:
        return plain[method](df)
    a, b = {"edge_in": (lambda x: x, e), "edge_out": (d, lambda x: x), "edge": (d, e), "top_hat": (lambda x: x, opened), "bottom_hat": (closed, lambda x: x)}[method]
    return a(df).join(b(df).withColumnRenamed("v", "o"), [key, "y", "x"]).select(key, "y", "x", (F.col("v") - F.col("o")).alias("v"))


def adaptive_threshold(df: DataFrame, width: int = 3, height: int = 3, bias: float = 0.0, key: str = "image_id") -> DataFrame:
    mean = statistic(df, "mean", width, height, key).withColumnRenamed("v", "m")
    return df.join(mean, [key, "y", "x"]).withColumn("v", F.when(F.col("v") <= F.col("m") + bias, 0.0).otherwise(65535.0)).drop("m")


def integral(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Sums of all samples above and to the left: a running sum along rows, then along columns."""
    rows = df.withColumn("v", F.sum("v").over(W.partitionBy(key, "y").orderBy("x")))
    return rows.withColumn("v", F.sum("v").over(W.partitionBy(key, "x").orderBy("y")))


def shade(df: DataFrame, azimuth: float, elevation: float, key: str = "image_id") -> DataFrame:
    """Light from a direction on the surface that the samples make."""
    lx, ly, lz = math.cos(math.radians(azimuth)) * math.cos(math.radians(elevation)), math.sin(math.radians(azimuth)) * math.cos(math.radians(elevation)), math.sin(math.radians(elevation))
    pixels, samples = near(df, rectangle(3, 3), key=key)
    n = pixels.select(key, "y", "x", *(F.coalesce(p["n"], F.lit(0.0)).alias(f"n{i}") for i, p in enumerate(samples)))
    n = n.selectExpr(key, "y", "x", "(n0 + n3 + n6 - n2 - n5 - n8) / 65535e0 as nx", "(n6 + n7 + n8 - n0 - n1 - n2) / 65535e0 as ny", "2e0 as nz")
    dot = F.col("nx") * lx + F.col("ny") * ly + F.col("nz") * lz
    return n.select(key, "y", "x", (65535.0 * F.greatest(dot / F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(0.0))).alias("v"))
