"""Pixels outside of an image, and samples between pixels.

A view is any rectangle of the plane; a rule says which pixel, or which constant, stands at each of its places. Both
operators join the places they are asked for with the pixels on image, row and column, so a shuffle carries the
output's rows, times the taps of the interpolation, and the image itself once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import QR

#: The offsets of dithered places, by the last three bits of the coordinate; less 32.
DITHER = (0, 48, 12, 60, 3, 51, 15, 63)
#: What stands outside where a rule has a constant: the sample and the alpha.
CONSTANT = {"black": (0.0, QR), "gray": (QR / 2, QR), "white": (QR, QR), "transparent": (0.0, 0.0)}
METHODS = (*CONSTANT, "background", "constant", "edge", "none", "tile", "mirror", "dither", "random", "checker_tile", "horizontal_tile", "horizontal_tile_edge", "vertical_tile", "vertical_tile_edge")


def _place(method: str, i: str, n: str, seed: int) -> str:
    """The coordinate that a place takes its pixel from, along one axis of length n; null where it takes the constant."""
    edge, tile = f"greatest(0, least({n} - 1, {i}))", f"pmod({i}, {n})"
    if method in CONSTANT or method in ("background", "constant"):
        return f"CASE WHEN {i} BETWEEN 0 AND {n} - 1 THEN {i} END"
    if method in ("edge", "none"):
        return edge
    if method in ("tile", "checker_tile"):
        return tile
    if method == "mirror":
        return f"CASE WHEN pmod(floor({i} / {n}), 2) = 1 THEN {n} - 1 - {tile} ELSE {tile} END"
    if method == "dither":
        return f"greatest(0, least({n} - 1, {i} + element_at(array({', '.join(map(str, DITHER))}), int({i} & 7) + 1) - 32))"
    if method == "random":
        return f"pmod(xxhash64({seed}, '{i}', __key, y, x), {n})"
    along = "x" if method.startswith("horizontal") else "y"
    if i == along:
        return tile
    return edge if method.endswith("edge") else f"CASE WHEN {i} BETWEEN 0 AND {n} - 1 THEN {i} END"


def view(df: DataFrame, y: int, x: int, height: int, width: int, method: str = "edge", background: float = 0.0, seed: int = 1, key: str = "image_id") -> DataFrame:
    """key, y, x, v, a: ``height`` x ``width`` pixels of each image from (y, x) on, of which any may lie outside.

    ``tile`` and its relatives repeat the image, ``mirror`` turns every second copy, ``checker_tile`` leaves every
    second one out, ``dither`` and ``random`` (seeded) take some pixel of the image; the others have a constant.
    """
    if method not in METHODS:
        raise ValueError(f"no rule {method} for pixels outside")
    size = df.groupBy(F.col(key).alias("__key")).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    at = size.withColumn("y", F.explode(F.sequence(F.lit(y), F.lit(y + height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(x), F.lit(x + width - 1))))
    inside = "y BETWEEN 0 AND h - 1 AND x BETWEEN 0 AND w - 1"
    ny, nx = (F.expr(f"CASE WHEN {inside} THEN {i} ELSE {_place(method, i, n, seed)} END") for i, n in (("y", "h"), ("x", "w")))
    if method == "checker_tile":
        ny = F.when(F.expr("pmod(floor(y / h) + floor(x / w), 2) = 0"), ny)
    at = at.select("__key", "y", "x", ny.cast("int").alias("__y"), nx.cast("int").alias("__x"))
    there = df.select(F.col(key).alias("__key"), F.col("y").cast("int").alias("__y"), F.col("x").cast("int").alias("__x"), "v")
    v, a = CONSTANT.get(method, (background, QR))
    out = F.isnull("__y") | F.isnull("__x")
    return at.join(there, ["__key", "__y", "__x"], "left").select(
        F.col("__key").alias(key), "y", "x", F.when(out, F.lit(float(v))).otherwise(F.col("v")).alias("v"), F.when(out, F.lit(float(a))).otherwise(F.lit(QR)).alias("a")
    )


def _cubic(b: float, c: float, t: Column) -> Column:
    """The cubic filters of two parameters, at a distance of up to 2."""
    t = F.abs(t)
    near = ((12 - 9 * b - 6 * c) * t * t * t + (-18 + 12 * b + 6 * c) * t * t + (6 - 2 * b)) / 6.0
    far = ((-b - 6 * c) * t * t * t + (6 * b + 30 * c) * t * t + (-12 * b - 48 * c) * t + (8 * b + 24 * c)) / 6.0
    return F.when(t < 1, near).when(t < 2, far).otherwise(0.0)


def _half(j: Column, f: Column) -> Column:
    """Weights of two neighbours that are taken alone near them and in equal parts between."""
    return F.when(f >= 0.75, (j == 1).cast("double")).when(f > 0.25, F.lit(0.5)).otherwise((j == 0).cast("double"))


#: By method: the taps along an axis counted from the pixel at or before the place, and a tap's weight j at fraction f.
INTERPOLATE = {
    "integer": ((0,), lambda j, f: F.lit(1.0)),
    "nearest": ((0, 1), lambda j, f: F.when(f >= 0.5, (j == 1).cast("double")).otherwise((j == 0).cast("double"))),
    "average4": ((0, 1), lambda j, f: F.lit(0.5)),
    "average9": ((-1, 0, 1, 2), lambda j, f: F.when(j == F.when(f >= 0.5, -1).otherwise(2), 0.0).otherwise(1.0 / 3.0)),
    "average16": ((-1, 0, 1, 2), lambda j, f: F.lit(0.25)),
    "bilinear": ((0, 1), lambda j, f: 1.0 - F.abs(f - j)),
    "blend": ((0, 1), _half),
    "catrom": ((-1, 0, 1, 2), lambda j, f: _cubic(0.0, 0.5, f - j)),
    "spline": ((-1, 0, 1, 2), lambda j, f: _cubic(1.0, 0.0, f - j)),
}
INTERPOLATE["average"] = INTERPOLATE["average4"]
INTERPOLATE["nearest_neighbor"] = INTERPOLATE["nearest"]


def _mesh(corner: dict[tuple[int, int], Column], fy: Column, fx: Column) -> Column:
    """The plane over the triangle that holds the place; the square is cut along the diagonal of the smaller step."""
    tl, tr, bl, br = (corner[k] for k in ((0, 0), (0, 1), (1, 0), (1, 1)))
    plane = lambda at, right, down, x, y: at + (right - at) * x + (down - at) * y
    falling = F.when(fx <= fy, plane(bl, br, tl, fx, 1 - fy)).otherwise(plane(tr, tl, br, 1 - fx, fy))
    rising = F.when(fx <= 1 - fy, plane(tl, tr, bl, fx, fy)).otherwise(plane(br, bl, tr, 1 - fx, 1 - fy))
    return F.when(F.abs(tl - br) < F.abs(tr - bl), falling).otherwise(rising)


def interpolate(df: DataFrame, points: DataFrame, method: str = "bilinear", key: str = "image_id") -> DataFrame:
    """key, y, x, v: the samples of each image at ``points`` (key, y, x and their places py and px). Edges repeat; a point without an image has none."""
    mesh = method == "mesh"
    taps, weight = INTERPOLATE["bilinear" if mesh else method]
    size = df.groupBy(key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    axis = F.array(*(F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in taps for j in taps))
    fy, fx = F.col("py") - F.floor("py"), F.col("px") - F.floor("px")
    at = points.join(size, key).select(key, "y", "x", "h", "w", fy.alias("fy"), fx.alias("fx"), F.floor("py").alias("iy"), F.floor("px").alias("ix"), F.explode(axis).alias("t"))
    at = at.withColumns({
        "k": weight(F.col("t.dy"), F.col("fy")) * weight(F.col("t.dx"), F.col("fx")),
        "ny": F.expr("int(greatest(0, least(h - 1, iy + t.dy)))"), "nx": F.expr("int(greatest(0, least(w - 1, ix + t.dx)))"),
    })
    there = df.select(key, F.col("y").cast("int").alias("ny"), F.col("x").cast("int").alias("nx"), "v")
    near = (at if mesh else at.where("k <> 0")).join(there, [key, "ny", "nx"])
    if not mesh:
        return near.groupBy(key, "y", "x").agg(F.sum(F.col("k") * F.col("v")).alias("v"))
    corners = {(i, j): F.max(F.when((F.col("t.dy") == i) & (F.col("t.dx") == j), F.col("v"))) for i in (0, 1) for j in (0, 1)}
    found = near.groupBy(key, "y", "x", "fy", "fx").agg(*(c.alias(f"c{i}{j}") for (i, j), c in corners.items()))
    return found.select(key, "y", "x", _mesh({k: F.col(f"c{k[0]}{k[1]}") for k in corners}, F.col("fy"), F.col("fx")).alias("v"))
