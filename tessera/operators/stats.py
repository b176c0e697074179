"""Statistics of whole images: one aggregate over pixels, grouped by image."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.core import QR


def statistics(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """area, minima, maxima, mean, sample variance and deviation, skewness and kurtosis over the sample deviation, lower median, entropy.

    Entropy is normalised by the logarithm of the number of occupied bins (integers 0..QR).
    """
    n = F.count(v).cast("double")
    base = df.groupBy(key).agg(
        F.count(v).alias("area"), F.min(v).alias("minima"), F.max(v).alias("maxima"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("standard_deviation"),
        (F.skewness(v) * F.pow((n - 1) / n, F.lit(1.5))).alias("skewness"), ((F.kurtosis(v) + 3.0) * F.pow((n - 1) / n, F.lit(2.0)) - 3.0).alias("kurtosis"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v})").alias("median"),
    )
    return base.join(entropy(df, v, key), key)


def entropy(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    bins = df.groupBy(key, F.floor(F.least(F.greatest(F.col(v), F.lit(0.0)), F.lit(QR)) + 0.5).alias("bin")).count()
    total = bins.groupBy(key).agg(F.sum("count").cast("double").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("s"), F.count(F.lit(1)).alias("k"))
    return total.select(key, F.when(F.col("k") > 1, (F.log2("n") - F.col("s") / F.col("n")) / F.log2("k")).otherwise(0.0).alias("entropy"))


def extrema(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """Least and largest sample as whole numbers, and the first place (y, x) of each."""
    at = lambda f, o: F.expr(f"{f}(named_struct('y', y, 'x', x), named_struct('v', {o}{v}, 'y', -y, 'x', -x))")
    return df.groupBy(key).agg(
        F.ceil(F.min(v) - 0.5).alias("minima"), F.floor(F.max(v) + 0.5).alias("maxima"), at("max_by", "-").alias("low"), at("max_by", "").alias("high")
    ).select(key, "minima", "maxima", F.col("low.y").alias("min_y"), F.col("low.x").alias("min_x"), F.col("high.y").alias("max_y"), F.col("high.x").alias("max_x"))


def moments(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """Centroid, ellipse axes, angle, eccentricity and the first two invariants; one pass over power sums, no second scan."""
    power = lambda p, q: F.sum(F.col(v) * F.pow(F.col("x").cast("double"), F.lit(float(p))) * F.pow(F.col("y").cast("double"), F.lit(float(q))))
    s = df.groupBy(key).agg(*(power(p, q).alias(f"s{p}{q}") for p in range(3) for q in range(3) if p + q <= 2))
    m = s.withColumns({"cx": F.expr("s10 / s00"), "cy": F.expr("s01 / s00")}).withColumns({"m20": F.expr("s20 / s00 - cx * cx"), "m02": F.expr("s02 / s00 - cy * cy"), "m11": F.expr("s11 / s00 - cx * cy")})
    root = "sqrt(4e0 * m11 * m11 + (m20 - m02) * (m20 - m02))"
    m = m.withColumns({"major": F.expr(f"sqrt(2e0 * (m20 + m02 + {root}))"), "minor": F.expr(f"sqrt(greatest(2e0 * (m20 + m02 - {root}), 0e0))")})
    return m.select(
        key, F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), "major", "minor", F.expr("0.5e0 * atan2(2e0 * m11, m20 - m02)").alias("angle"),
        F.expr("sqrt(greatest(1e0 - (minor * minor) / (major * major), 0e0))").alias("eccentricity"), F.expr("(m20 + m02) / s00").alias("i1"), F.expr("((m20 - m02) * (m20 - m02) + 4e0 * m11 * m11) / (s00 * s00)").alias("i2"),
    )


def histogram(df: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), key: str = "image_id") -> DataFrame:
    return df.groupBy(key, *channels).agg(F.count(F.lit(1)).alias("count"))


def unique_colors(df: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), key: str = "image_id") -> DataFrame:
    """Distinct colours of each image as a row of pixels, in the order of their values."""
    return df.select(key, *channels).distinct().withColumn("x", F.row_number().over(W.partitionBy(key).orderBy(*channels)) - 1)


def number_colors(df: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), key: str = "image_id") -> DataFrame:
    count = F.count_distinct(*channels)
    return df.groupBy(key).agg(count.alias("colors"), (count <= 256).alias("palette"), (count <= 1024).alias("histogram"))


def kinds(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Whether all pixels are gray, only black or white, opaque (no alpha below QR), and within 0..QR as whole numbers."""
    gray = F.bool_and((F.abs(F.col("r") - F.col("g")) < 1e-12) & (F.abs(F.col("g") - F.col("b")) < 1e-12))
    mono = F.bool_and(F.col("r").isin(0.0, QR) & (F.col("r") == F.col("g")) & (F.col("g") == F.col("b")))
    wide = F.bool_or((F.col("r") < 0) | (F.col("r") > QR) | (F.col("r") != F.rint("r")))
    return df.groupBy(key).agg(gray.alias("gray"), mono.alias("monochrome"), wide.alias("high_dynamic_range"))


def ink_density(df: DataFrame, channels: tuple[str, ...], key: str = "image_id") -> DataFrame:
    total = channels[0] if len(channels) == 1 else " + ".join(channels)
    return df.groupBy(key).agg(F.max(F.expr(total)).alias("density"))


def bounding_box(df: DataFrame, background: str, v: str = "v", key: str = "image_id") -> DataFrame:
    """The box of the pixels that differ from the background."""
    return df.where(F.col(v) != F.expr(background)).groupBy(key).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def texture(df: DataFrame, levels: int = 8, dx: int = 1, dy: int = 0, v: str = "v", key: str = "image_id") -> DataFrame:
    """Co-occurrence features at an offset: symmetric pairs of levels, as an equi-join of the pixels with themselves."""
    q = df.select(key, "y", "x", F.floor(F.least(F.col(v) / QR * levels, F.lit(levels - 1.0))).cast("int").alias("i"))
    other = q.select(F.col(key), (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("i").alias("j"))
    one = q.join(other, [key, "y", "x"]).select(key, "i", "j")
    counts = one.union(one.select(key, F.col("j").alias("i"), F.col("i").alias("j"))).groupBy(key, "i", "j").count()
    p = counts.withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy(key)))
    return p.groupBy(key).agg(
        F.sum(F.expr("p * p")).alias("angular_second_moment"), F.sum(F.expr("p * (i - j) * (i - j)")).alias("contrast"), F.sum(F.expr("p / (1 + (i - j) * (i - j))")).alias("inverse_difference"),
        (-F.sum(F.expr("p * log2(p)"))).alias("entropy"), F.sum(F.expr("p * (i + j)")).alias("sum_average"),
    )


def report(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """One JSON document per image: its size and statistics, rounded to whole numbers."""
    s = df.groupBy(key).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.round(F.min(v)).cast("long").alias("min"), F.round(F.max(v)).cast("long").alias("max"), F.round(F.avg(v)).cast("long").alias("mean"))
    return s.select(key, F.to_json(F.struct("width", "height", "min", "max", "mean")).alias("json"))


def hull(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Corners of the convex hull of an image's pixels, in order; only the ends of each row are looked at."""
    ends = df.groupBy(key, "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).select(key, "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))
    points = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))).alias("p"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chains = []
        p = [(int(a["x"]), int(a["y"])) for a in pdf["p"].iloc[0]]
        for way in (p, p[::-1]):
            chain: list[tuple[int, int]] = []
            for q in way:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append(q)
            chains.append(chain)
        corners = p if len(p) == 1 else chains[0][:-1] + chains[1][:-1]
        return pd.DataFrame({key: pdf[key].iloc[0], "k": range(len(corners)), "x": [c[0] for c in corners], "y": [c[1] for c in corners]})

    return points.groupBy(key).applyInPandas(run, f"{key} long, k int, x int, y int")


def perceptual_hash(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """-log10 of the absolute first two invariants."""
    m = moments(df, v, key)
    return m.select(key, *((-F.log10(F.greatest(F.abs(F.col(i)), F.lit(1e-300)))).alias(f"h{n}") for n, i in ((1, "i1"), (2, "i2"))))
