"""Two images compared: an equi-join on coordinates and one aggregate for all metrics asked for."""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import doubles

#: Aggregates over a (source), b (reconstruction) on the scale 0 to 1; fuzz is the squared tolerance.
METRICS = {
    "ae": "avg(CASE WHEN (a - b) * (a - b) > {fuzz} THEN abs(a - b) ELSE 0.0 END)",
    "fuzz": "sum(CASE WHEN (a - b) * (a - b) > {fuzz} THEN (a - b) * (a - b) ELSE 0.0 END) / greatest(sum(CASE WHEN (a - b) * (a - b) > {fuzz} THEN 1.0 ELSE 0.0 END), 1.0)",
    "mae": "avg(abs(a - b))",
    "mse": "avg((a - b) * (a - b))",
    "rmse": "sqrt(avg((a - b) * (a - b)))",
    "pae": "max(abs(a - b))",
    "pdc": "sum(CASE WHEN (a - b) * (a - b) > {fuzz} THEN 1.0 ELSE 0.0 END)",
    "psnr": "log10(1.0 / greatest(avg((a - b) * (a - b)), 1.0e-12)) / 12.0",
    "dpc": "(1.0 - sum(a * b) / sqrt(sum(a * a) * sum(b * b))) / 2.0",
    "ncc": "(1.0 - (avg(a * b) - avg(a) * avg(b)) / sqrt((avg(a * a) - avg(a) * avg(a)) * (avg(b * b) - avg(b) * avg(b)))) / 2.0",
    "mepp": "sum(abs(a - b)) / count(*)",
    "ssim": "(1.0 - (2.0 * avg(a) * avg(b) + 0.0001) * (2.0 * (avg(a * b) - avg(a) * avg(b)) + 0.0009) / ((avg(a) * avg(a) + avg(b) * avg(b) + 0.0001) * (avg(a * a) - avg(a) * avg(a) + avg(b * b) - avg(b) * avg(b) + 0.0009))) / 2.0",
}
METRICS["dssim"] = METRICS["ssim"]


def metric(name: str, fuzz: float = 0.01) -> str:
    """SQL of a metric; pixels whose squared difference is within ``fuzz`` squared count as equal."""
    return doubles(METRICS[name].replace("{fuzz}", repr(fuzz * fuzz)))


def compare(pairs: DataFrame, names: tuple[str, ...] = tuple(METRICS), fuzz: float = 0.01, key: str = "image_id") -> DataFrame:
    """Per image the metrics of columns a and b."""
    return pairs.groupBy(key).agg(*(F.expr(metric(n, fuzz)).alias(n) for n in names))


def highlight(pairs: DataFrame, fuzz: float = 0.01) -> DataFrame:
    """``pairs`` with differs: whether a pixel's difference is beyond the tolerance."""
    return pairs.withColumn("differs", F.expr(doubles(f"(a - b) * (a - b) > {fuzz * fuzz!r}")))


#: Pixels of a template that one projection holds.
CELLS = 4096


def best_offset(image: DataFrame, template: DataFrame, key: str = "image_id") -> DataFrame:
    """Where a small image fits best, by mean squared error: each of its pixels meets each pixel of the image once, and pairs are summed by offset.

    The template is one small image (its pixels are few against those of the images); its pixels are constants of the
    plan, CELLS of them in each part of a union.
    """
    t = template.select(F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("v").alias("t"))
    size = t.agg(F.max("ty").alias("h"), F.max("tx").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"]:
        return image.select(key, F.col("y"), F.col("x"), F.lit(0.0).alias("error")).limit(0)
    parts, rows = [], t.toLocalIterator()
    while part := list(islice(rows, CELLS)):
        cells = F.array(*(F.struct(F.lit(r.ty).alias("ty"), F.lit(r.tx).alias("tx"), F.lit(r.t).alias("t")) for r in part))
        met = image.select(key, "y", "x", "v", F.explode(cells).alias("c")).select(key, (F.col("y") - F.col("c.ty")).alias("y"), (F.col("x") - F.col("c.tx")).alias("x"), F.pow(F.col("v") - F.col("c.t"), F.lit(2.0)).alias("e"))
        parts.append(met.groupBy(key, "y", "x").agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("n")))
    met = reduce(DataFrame.union, parts)
    by = met.groupBy(key, "y", "x").agg((F.sum("e") / F.sum("n")).alias("error"), F.sum("n").alias("n")).where(F.col("n") == size["n"])
    return by.groupBy(key).agg(F.min(F.struct("error", "y", "x")).alias("m")).select(key, "m.y", "m.x", "m.error")
