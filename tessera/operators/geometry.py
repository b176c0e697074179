"""Remaps of coordinates: projections over y and x, with the image's size by window where it is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sizes(df: DataFrame, key: str = "image_id") -> DataFrame:
    """height and width of each image, as columns of its pixels."""
    found = df.groupBy(key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return df.join(found, key)


def _remap(df: DataFrame, y: str, x: str, sized: bool = True) -> DataFrame:
    out = sizes(df) if sized else df
    return out.withColumns({"y": F.expr(y).cast("int"), "x": F.expr(x).cast("int")}).drop("h", "w")


def flip(df: DataFrame) -> DataFrame:
    return _remap(df, "h - 1 - y", "x")


def flop(df: DataFrame) -> DataFrame:
    return _remap(df, "y", "w - 1 - x")


def transpose(df: DataFrame) -> DataFrame:
    return _remap(df, "x", "y", False)


def transverse(df: DataFrame) -> DataFrame:
    return _remap(df, "w - 1 - x", "h - 1 - y")


def rotate(df: DataFrame, turns: int) -> DataFrame:
    """Quarter turns to the right."""
    return df if turns % 4 == 0 else _remap(df, *{1: ("x", "h - 1 - y"), 2: ("h - 1 - y", "w - 1 - x"), 3: ("w - 1 - x", "y")}[turns % 4])


def roll(df: DataFrame, dx: int, dy: int) -> DataFrame:
    return _remap(df, f"pmod(y + {dy}, h)", f"pmod(x + {dx}, w)")


def crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    return df.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def shave(df: DataFrame, dx: int, dy: int) -> DataFrame:
    inside = sizes(df).where((F.col("x") >= dx) & (F.col("x") < F.col("w") - dx) & (F.col("y") >= dy) & (F.col("y") < F.col("h") - dy))
    return inside.withColumns({"x": F.col("x") - dx, "y": F.col("y") - dy}).drop("h", "w")


def chop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Takes columns and rows out and closes the gap."""
    kept = df.where(~F.col("x").between(x, x + width - 1) & ~F.col("y").between(y, y + height - 1))
    return kept.withColumns({"x": F.when(F.col("x") >= x + width, F.col("x") - width).otherwise(F.col("x")), "y": F.when(F.col("y") >= y + height, F.col("y") - height).otherwise(F.col("y"))})


def extent(df: DataFrame, width: int, height: int, dx: int = 0, dy: int = 0, background: float = 0.0, key: str = "image_id") -> DataFrame:
    """A canvas of a given size with the image at (dx, dy) and a background around it."""
    grid = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select(key, "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    moved = df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    rest = [c for c in df.columns if c not in (key, "y", "x")]
    return grid.join(moved, [key, "y", "x"], "left").select(key, "y", "x", *(F.coalesce(c, F.lit(background)).alias(c) for c in rest))


def splice(df: DataFrame, x: int, y: int, width: int, height: int, background: float = 0.0, key: str = "image_id") -> DataFrame:
    """Puts background columns and rows in."""
    moved = df.withColumns({"x": F.when(F.col("x") >= x, F.col("x") + width).otherwise(F.col("x")), "y": F.when(F.col("y") >= y, F.col("y") + height).otherwise(F.col("y"))})
    size = sizes(df, key).select(key, "h", "w").distinct()
    grid = size.select(key, F.explode(F.expr(f"sequence(0, int(h) + {height - 1})")).alias("y"), "w").select(key, "y", F.explode(F.expr(f"sequence(0, int(w) + {width - 1})")).alias("x"))
    rest = [c for c in df.columns if c not in (key, "y", "x")]
    return grid.join(moved, [key, "y", "x"], "left").select(key, "y", "x", *(F.coalesce(c, F.lit(background)).alias(c) for c in rest))


def tiles(df: DataFrame, width: int, height: int) -> DataFrame:
    return df.withColumns({"ty": F.floor(F.col("y") / height).cast("int"), "tx": F.floor(F.col("x") / width).cast("int"), "y": F.col("y") % height, "x": F.col("x") % width})


def append(frames: DataFrame, stack: bool = False, key: str = "image_id") -> DataFrame:
    """The frames of a list beside each other, or below; each begins where those before it end."""
    axis = "y" if stack else "x"
    size = frames.groupBy(key, "scene").agg((F.max(axis) + 1).alias("n"))
    at = size.select(key, "scene", F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("scene").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    return frames.join(at, [key, "scene"]).withColumn(axis, (F.col(axis) + F.col("at")).cast("int")).drop("at", "scene")


def trim(df: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Crops each image to its own box."""
    b = boxes.select(key, F.col("x").alias("bx"), F.col("y").alias("by"), "width", "height")
    inside = df.join(b, key).where("x >= bx and x < bx + width and y >= by and y < by + height")
    return inside.withColumns({"x": F.col("x") - F.col("bx"), "y": F.col("y") - F.col("by")}).drop("bx", "by", "width", "height")


def raise_edges(df: DataFrame, width: int, up: bool = True) -> DataFrame:
    """A bevel: pixels near an edge lighter or darker by a fixed share."""
    light, dark = (190.0, 135.0) if up else (135.0, 190.0)
    edge = F.when((F.col("x") < width) | (F.col("y") < width), light).when((F.col("x") >= F.col("w") - width) | (F.col("y") >= F.col("h") - width), dark)
    return sizes(df).withColumn("v", F.coalesce((F.col("v") * edge + 65535.0 * F.when(edge == 190.0, 65.0).otherwise(0.0)) / 255.0, F.col("v"))).drop("h", "w")


def border(df: DataFrame, dx: int, dy: int, colour: float, key: str = "image_id") -> DataFrame:
    """A frame of one colour around images of one size or several."""
    size = sizes(df, key).select(key, "h", "w").distinct()
    grid = size.select(key, F.explode(F.expr(f"sequence(0, int(h) + {2 * dy - 1})")).alias("y"), "w").select(key, "y", F.explode(F.expr(f"sequence(0, int(w) + {2 * dx - 1})")).alias("x"))
    moved = df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    rest = [c for c in df.columns if c not in (key, "y", "x")]
    return grid.join(moved, [key, "y", "x"], "left").select(key, "y", "x", *(F.coalesce(c, F.lit(colour)).alias(c) for c in rest))


def sort_pixels(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """Each row's pixels by ascending sample, equal ones as they were."""
    return df.withColumn("x", F.row_number().over(W.partitionBy(key, "y").orderBy(v, "x")) - 1)


#: By the number of an orientation, what shows the image upright.
_UPRIGHT = {1: lambda d: d, 2: flop, 3: lambda d: rotate(d, 2), 4: flip, 5: transpose, 6: lambda d: rotate(d, 1), 7: transverse, 8: lambda d: rotate(d, 3)}
ORIENTATIONS = {"top_left": 1, "top_right": 2, "bottom_right": 3, "bottom_left": 4, "left_top": 5, "right_top": 6, "right_bottom": 7, "left_bottom": 8}


def upright(df: DataFrame, orientation: int | str) -> DataFrame:
    """An image whose first row and column lie as ``orientation`` says (a name, or its number), turned to top left."""
    return _UPRIGHT[ORIENTATIONS.get(orientation, orientation)](df)


GRAVITIES = ("north_west", "north", "north_east", "west", "center", "east", "south_west", "south", "south_east")


def anchored(gravity: str, width: int, height: int, dx: int = 0, dy: int = 0) -> tuple[str, str]:
    """SQL of the left and top of a box in a page of size w and h: (dx, dy) goes inwards from the side that pulls; ``none`` and ``forget`` pull to north west."""
    across, down = gravity.endswith(("east", "west")), gravity.startswith(("north", "south"))
    if gravity in ("none", "forget"):
        across = down = True
    x = f"w - {width} - ({dx})" if gravity.endswith("east") else f"{dx}" if across else f"floor(w / 2) - {width // 2} + ({dx})"
    y = f"h - {height} - ({dy})" if gravity.startswith("south") else f"{dy}" if down else f"floor(h / 2) - {height // 2} + ({dy})"
    return x, y


def gravity_crop(df: DataFrame, gravity: str, width: int, height: int, dx: int = 0, dy: int = 0) -> DataFrame:
    """``width`` x ``height`` pixels of each image, where gravity pulls the box."""
    x, y = anchored(gravity, width, height, dx, dy)
    boxed = sizes(df).withColumns({"__x": F.expr(f"int({x})"), "__y": F.expr(f"int({y})")})
    kept = boxed.where(f"x BETWEEN __x AND __x + {width - 1} AND y BETWEEN __y AND __y + {height - 1}")
    return kept.withColumns({"x": (F.col("x") - F.col("__x")).cast("int"), "y": (F.col("y") - F.col("__y")).cast("int")}).drop("__x", "__y", "h", "w")
