"""Image lists: frames keyed by image_id and scene. Pixels are matched by coordinates, frames by order of scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from tessera.core import QR

def _by() -> WindowSpec:
    """A pixel through the frames."""
    return W.partitionBy("image_id", "y", "x").orderBy("scene")


def _samples() -> Column:
    """A pixel's samples by scene."""
    return F.transform(F.array_sort(F.collect_list(F.struct("scene", "v"))), lambda s: s["v"])


#: Folds over a pixel's samples p, in order of scene: the first is taken as it is, each later one meets the result so far.
FOLDS = {
    "add": lambda a, v: a + v,
    "subtract": lambda a, v: v - a,
    "divide": lambda a, v: v / F.when(F.abs(a) < 1e-12, 1e-12).otherwise(a),
    "multiply": lambda a, v: a * v / QR,
    "max": lambda a, v: F.greatest(a, v),
    "min": lambda a, v: F.least(a, v),
    "difference": lambda a, v: F.abs(v - a),
}


def evaluate_sequence(frames: DataFrame, op: str) -> DataFrame:
    """One image from a list, pixel by pixel."""
    g = frames.groupBy("image_id", "y", "x")
    if op in ("mean", "sum"):
        return g.agg((F.avg if op == "mean" else F.sum)("v").alias("v"))
    if op == "median":
        s = F.array_sort(F.collect_list("v"))
        return g.agg(F.element_at(s, F.expr("int(count(v) div 2) + 1")).alias("v"))
    if op == "rms":
        return g.agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("v"))
    fold = FOLDS[op]
    return g.agg(_samples().alias("p")).select("image_id", "y", "x", F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.element_at("p", 1), fold).alias("v"))


def polynomial(frames: DataFrame, terms: list[tuple[float, float]]) -> DataFrame:
    """QR times the sum of weight times sample to the power degree, over the frames in order of scene."""
    pairs = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(d).alias("d")) for w, d in terms))
    part = F.get(pairs, F.col("scene"))
    return frames.groupBy("image_id", "y", "x").agg((QR * F.sum(part["w"] * F.pow(F.col("v") / QR, part["d"]))).alias("v"))


def changed_box(frames: DataFrame, fuzz: float = 0.0) -> DataFrame:
    """Of each frame the box of pixels that differ from the frame before."""
    d = frames.withColumn("p", F.lag("v").over(_by())).where(F.col("p").isNotNull() & (F.abs(F.col("v") - F.col("p")) > fuzz))
    return d.groupBy("image_id", "scene").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def coalesce(frames: DataFrame) -> DataFrame:
    """Full frames: a pixel without a sample shows the last one before it."""
    return frames.withColumn("v", F.last("v", True).over(_by().rowsBetween(W.unboundedPreceding, 0)))


def optimize_transparency(frames: DataFrame) -> DataFrame:
    """Pixels that don't change become null."""
    return frames.withColumn("v", F.when(F.lag("v").over(_by()) == F.col("v"), F.lit(None)).otherwise(F.col("v")))


def remove_duplicates(frames: DataFrame, delays: DataFrame) -> DataFrame:
    """scene and delay of the frames that stay: one equal to the next goes, and its delay is added to that one's."""
    size = frames.groupBy("image_id", "scene").agg(F.count(F.lit(1)).alias("n"))
    follow = frames.withColumns({"nv": F.lead("v").over(_by()), "ns": F.lead("scene").over(_by())})
    same = follow.groupBy("image_id", "scene").agg((F.count_if(F.col("nv") == F.col("v")) == F.count(F.lit(1))).alias("same"))
    by = W.partitionBy("image_id").orderBy(F.desc("scene"))
    runs = delays.join(same, ["image_id", "scene"]).join(size, ["image_id", "scene"]).withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(by))
    return runs.groupBy("image_id", "run").agg(F.max("scene").alias("scene"), F.sum("delay").alias("delay")).drop("run")


def remove_zero_delays(delays: DataFrame) -> DataFrame:
    """Frames that are shown for no time go, unless all are."""
    any_shown = F.max("delay").over(W.partitionBy("image_id")) > 0
    return delays.withColumn("any", any_shown).where((F.col("delay") > 0) | ~F.col("any")).drop("any")


def morph(frames: DataFrame, between: int) -> DataFrame:
    """Frames of one size with ``between`` tweens from each to the next; scenes are numbered anew."""
    n = between + 1
    pair = frames.withColumn("nv", F.lead("v").over(_by()))
    steps = pair.select("*", F.explode(F.when(F.col("nv").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(between)))).alias("k"))
    beta = F.col("k") / F.lit(float(n))
    rank = F.dense_rank().over(W.partitionBy("image_id", "y", "x").orderBy("scene", "k")) - 1
    return steps.withColumn("v", F.when(F.col("k") == 0, F.col("v")).otherwise((1 - beta) * F.col("v") + beta * F.col("nv"))).withColumn("scene", rank).drop("nv", "k")


def flatten(frames: DataFrame) -> DataFrame:
    """The last frame with a sample wins at each pixel."""
    return frames.where("v is not null").groupBy("image_id", "y", "x").agg(F.max_by("v", "scene").alias("v"))


def select_scenes(frames: DataFrame, scenes: str) -> DataFrame:
    """Frames by an index list such as ``0,2-4,-1``; negative numbers count from the end."""
    out = None
    n = F.max("scene").over(W.partitionBy("image_id")) + 1
    sized = frames.withColumn("n", n)
    for part in scenes.split(","):
        a, b = (part.split("-")[0], part.split("-")[1]) if "-" in part[1:] and part[0] != "-" else (part, part)
        low, high = (F.lit(int(a)) if int(a) >= 0 else F.col("n") + int(a)), (F.lit(int(b)) if int(b) >= 0 else F.col("n") + int(b))
        test = F.col("scene").between(low, high)
        out = test if out is None else out | test
    return sized.where(out).drop("n")


def delete_scenes(frames: DataFrame, scenes: str) -> DataFrame:
    return frames.join(select_scenes(frames, scenes).select("image_id", "scene").distinct(), ["image_id", "scene"], "left_anti")


def reverse(frames: DataFrame) -> DataFrame:
    return frames.withColumn("scene", F.max("scene").over(W.partitionBy("image_id")) - F.col("scene"))


def duplicate(frames: DataFrame, times: int) -> DataFrame:
    """Each list again behind itself."""
    n = F.max("scene").over(W.partitionBy("image_id")) + 1
    return frames.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.lit(times))).alias("k")).withColumn("scene", (F.col("scene") + F.col("k") * F.col("n")).cast("int")).drop("n", "k")


def montage(frames: DataFrame, columns: int) -> DataFrame:
    """A contact sheet: frames of one size in cells, row by row."""
    size = frames.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return frames.join(size, "image_id").select("image_id", (F.floor(F.col("scene") / columns) * F.col("h") + F.col("y")).cast("int").alias("y"), (F.col("scene") % columns * F.col("w") + F.col("x")).cast("int").alias("x"), "v")


def complex_pairs(pairs: DataFrame, op: str, snr: float = 0.0) -> DataFrame:
    """Complex arithmetic on columns ar, ai, br, bi."""
    a, b, c, d = (F.col(x) for x in ("ar", "ai", "br", "bi"))
    norm = c * c + d * d + snr
    real, imaginary = {
        "add": (a + c, b + d),
        "subtract": (a - c, b - d),
        "multiply": (a * c - b * d, a * d + b * c),
        "divide": ((a * c + b * d) / norm, (b * c - a * d) / norm),
        "conjugate": (a, -b),
        "magnitude_phase": (F.sqrt(a * a + b * b), F.atan2(b, a) / (2 * F.pi()) + 0.5),
        "real_imaginary": (a * F.cos(2 * F.pi() * (b - 0.5)), a * F.sin(2 * F.pi() * (b - 0.5))),
    }[op]
    return pairs.withColumns({"real": real, "imaginary": imaginary})


def append_list(a: DataFrame, b: DataFrame) -> DataFrame:
    """The frames of b behind those of a."""
    n = a.groupBy("image_id").agg((F.max("scene") + 1).alias("n"))
    return a.unionByName(b.join(n, "image_id", "left").withColumn("scene", (F.col("scene") + F.coalesce("n", F.lit(0))).cast("int")).drop("n"))


def insert_frame(frames: DataFrame, frame: DataFrame, at: int) -> DataFrame:
    """A frame (image_id, y, x, v) before the one at an index; those from there on move up."""
    moved = frames.withColumn("scene", F.when(F.col("scene") >= at, F.col("scene") + 1).otherwise(F.col("scene")).cast("int"))
    return moved.unionByName(frame.withColumn("scene", F.lit(at)))


def swap_frames(frames: DataFrame, a: int, b: int) -> DataFrame:
    return frames.withColumn("scene", F.when(F.col("scene") == a, b).when(F.col("scene") == b, a).otherwise(F.col("scene")).cast("int"))


def export_pixels(df: DataFrame, channels: tuple[str, ...], key: str = "image_id") -> DataFrame:
    """Each image's samples as one array, row by row, channels side by side."""
    pixel = F.struct("y", "x", F.array(*channels).alias("s"))
    return df.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(pixel)), lambda p: p["s"])).alias("samples"))


def import_pixels(rows: DataFrame, width: int, channels: tuple[str, ...], key: str = "image_id") -> DataFrame:
    """The inverse, for images of a known width."""
    n = len(channels)
    each = rows.select(key, F.posexplode("samples").alias("i", "v"))
    return each.groupBy(key, F.floor(F.col("i") / (n * width)).cast("int").alias("y"), F.floor(F.col("i") / n % width).cast("int").alias("x")).agg(*(F.max(F.when(F.col("i") % n == k, F.col("v"))).alias(c) for k, c in enumerate(channels)))


def stereo(left: DataFrame, right: DataFrame) -> DataFrame:
    """Red from the left image, green and blue from the right."""
    return left.select("image_id", "y", "x", "r").join(right.select("image_id", "y", "x", "g", "b"), ["image_id", "y", "x"])


def tiled(df: DataFrame, tile: DataFrame, height: int, width: int) -> DataFrame:
    """Each pixel with the sample t of a tile that repeats over the image; the tile is height x width."""
    t = tile.where((F.col("y") < height) & (F.col("x") < width)).select(F.col("y").cast("int").alias("ty"), F.col("x").cast("int").alias("tx"), F.col("v").alias("t"))
    return df.join(t, (F.pmod("y", F.lit(height)) == F.col("ty")) & (F.pmod("x", F.lit(width)) == F.col("tx"))).drop("ty", "tx")
