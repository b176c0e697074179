"""Histogram-driven transfer: a histogram per image, cumulative counts by window, joined back on the bin.

Bins are 256 levels, so a histogram has at most 256 rows per image and its windows stay small whatever the image's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.core import QR

BINS = 256


def _bin(v: str) -> Column:
    return F.least(F.greatest(F.floor(F.col(v) / QR * (BINS - 1) + 0.5), F.lit(0)), F.lit(BINS - 1)).cast("int")


def bins(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """key, bin, n, below (up to and with the bin), total."""
    h = df.groupBy(key, _bin(v).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(key)
    return h.select("*", F.sum("n").over(by.orderBy("bin")).alias("below"), F.sum("n").over(by).alias("total"))


def equalize(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """QR (cdf - cdf of the first bin) / (1 - that)."""
    h = bins(df, v, key)
    by = W.partitionBy(key)
    level = h.select(key, "bin", F.min("below").over(by).alias("first"), "below", "total").select(
        key, "bin", F.when(F.col("total") > F.col("first"), QR * (F.col("below") - F.col("first")) / (F.col("total") - F.col("first"))).otherwise(F.lit(None)).alias("level")
    )
    return df.withColumn("bin", _bin(v)).join(level, [key, "bin"]).withColumn(v, F.coalesce("level", v)).drop("bin", "level")


def _ends(df: DataFrame, black: float, white: float, v: str, key: str) -> DataFrame:
    """The first bin with more than ``black`` of the pixels up to it, and the last with more than 1 - ``white`` of them from it on."""
    h = bins(df, v, key).withColumn("above", F.col("total") - F.col("below") + F.col("n"))
    low = F.min(F.when(F.col("below") > black * F.col("total"), F.col("bin")))
    high = F.max(F.when(F.col("above") > (1 - white) * F.col("total"), F.col("bin")))
    return h.groupBy(key).agg(low.alias("low"), high.alias("high"))


def contrast_stretch(df: DataFrame, black: float = 0.02, white: float = 0.99, v: str = "v", key: str = "image_id") -> DataFrame:
    scale = QR / (BINS - 1)
    found = df.join(_ends(df, black, white, v, key), key)
    out = F.when(F.col("high") > F.col("low"), F.least(F.greatest((F.col(v) - F.col("low") * scale) / ((F.col("high") - F.col("low")) * scale) * QR, F.lit(0.0)), F.lit(QR))).otherwise(F.col(v))
    return found.withColumn(v, out).drop("low", "high")


def auto_level(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    m = df.groupBy(key).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    return df.join(m, key).withColumn(v, F.when(F.col("hi") > F.col("lo"), QR * (F.col(v) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col(v))).drop("lo", "hi")


def auto_gamma(df: DataFrame, v: str = "v", key: str = "image_id") -> DataFrame:
    """v to the power 1 / gamma, gamma = log(mean) / log(0.5)."""
    m = df.groupBy(key).agg((F.log(F.avg(v) / QR) / F.log(F.lit(0.5))).alias("gamma"))
    return df.join(m, key).withColumn(v, QR * F.pow(F.greatest(F.col(v), F.lit(0.0)) / QR, 1 / F.col("gamma"))).drop("gamma")


def auto_threshold(df: DataFrame, method: str = "otsu", v: str = "v", key: str = "image_id") -> DataFrame:
    """key, threshold (a bin): the bin that separates best; the lowest of equals."""
    h = bins(df, v, key)
    by = W.partitionBy(key)
    up = by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    if method == "otsu":
        s = h.select(key, "bin", (F.col("below") / F.col("total")).alias("w"), (F.sum(F.col("bin") * F.col("n")).over(up) / F.col("total")).alias("m"), (F.sum(F.col("bin") * F.col("n")).over(by) / F.col("total")).alias("mt"))
        worth = F.when((F.col("w") > 0) & (F.col("w") < 1), F.pow(F.col("mt") * F.col("w") - F.col("m"), F.lit(2.0)) / (F.col("w") * (1 - F.col("w")))).otherwise(0.0)
    elif method == "kapur":
        p = F.col("n") / F.col("total")
        s = h.select(key, "bin", (F.col("below") / F.col("total")).alias("w"), F.sum(p * F.log(p)).over(up).alias("e"), F.sum(p * F.log(p)).over(by).alias("et"))
        worth = F.when((F.col("w") > 0) & (F.col("w") < 1), F.log("w") - F.col("e") / F.col("w") + F.log(1 - F.col("w")) - (F.col("et") - F.col("e")) / (1 - F.col("w"))).otherwise(0.0)
    else:  # triangle: farthest from the line between the highest bin and the far end
        peak = h.select("*", F.max(F.struct(F.col("n"), -F.col("bin"))).over(by).alias("p"), F.min("bin").over(by).alias("first"), F.max("bin").over(by).alias("last"))
        s = peak.select(key, "bin", "n", F.col("p.n").alias("pn"), (-F.col("p")["col2"]).alias("pb"), "first", "last")
        far = F.when(F.col("pb") - F.col("first") > F.col("last") - F.col("pb"), F.col("first")).otherwise(F.col("last"))
        s = s.withColumn("far", far)
        worth = F.when((F.col("far") != F.col("pb")) & F.col("bin").between(F.least("pb", "far"), F.greatest("pb", "far")), F.abs(F.col("far") - F.col("bin")) * F.col("pn") / F.abs(F.col("far") - F.col("pb")) - F.col("n")).otherwise(0.0)
    best = s.withColumn("worth", F.round(worth, 9)).groupBy(key).agg(F.max(F.struct("worth", -F.col("bin"))).alias("b"))
    return best.select(key, (-F.col("b")["col2"]).alias("threshold"))


def linear_stretch(df: DataFrame, black: float = 0.02, white: float = 0.01, v: str = "v", key: str = "image_id") -> DataFrame:
    """Levels between the first bins from below and from above whose pixels make up the shares."""
    h = bins(df, v, key).withColumn("above", F.col("total") - F.col("below") + F.col("n"))
    ends = h.groupBy(key).agg(F.min(F.when(F.col("below") >= black * F.col("total"), F.col("bin"))).alias("low"), F.max(F.when(F.col("above") >= white * F.col("total"), F.col("bin"))).alias("high"))
    scale = QR / (BINS - 1)
    out = F.when(F.col("high") > F.col("low"), QR * (F.col(v) - F.col("low") * scale) / ((F.col("high") - F.col("low")) * scale)).otherwise(F.col(v))
    return df.join(ends, key).withColumn(v, out).drop("low", "high")
