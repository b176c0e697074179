"""Rasters as tables: one row per pixel, keyed by image, y and x, one double column per channel on the scale 0 to QR.

Formulas are SQL expressions, so that Catalyst compiles them with what stands around them. Numbers in them
are made doubles, as decimal arithmetic would round.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest sample value: 16 bits, kept as a double that may lie outside.
QR = 65535.0
EPSILON = 1.0e-12


def doubles(sql: str) -> str:
    """Decimal literals as doubles."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


def formula(template: str, **names: object) -> str:
    """A template with columns and numbers put in for {names}."""
    return doubles(template.format(**{k: f"({v!r}e0)" if isinstance(v, float) and "e" not in repr(v) else f"({v!r})" if isinstance(v, (int, float)) else v for k, v in names.items()}))


def column(template: str, **names: object) -> Column:
    return F.expr(formula(template, **names))


def reciprocal(x: str) -> str:
    """1/x, or 1e12 where x is next to 0, whatever its sign."""
    return f"(CASE WHEN abs({x}) < 1.0e-12 THEN 1.0e12 ELSE 1.0e0 / ({x}) END)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: each vector as 8 x 8 samples, from -1..1 to 0..QR."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e")).select(
        "image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), ((F.col("e").cast("double") + 1.0) / 2.0 * QR).alias("v")
    )


def order_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, r, g, b: the lines of an order are a row; supplier groups are images."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 16).alias("image_id"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").cast("int").alias("x"),
        (F.col("l_quantity") / 50.0 * QR).alias("r"), (F.col("l_discount") * 10.0 * QR).alias("g"), (F.col("l_tax") * 12.5 * QR).alias("b"),
    )


def pair_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x and, on the scale 0 to 1, a source with alpha (sc, sa) over a canvas (dc, da): each vector over the next one."""
    e = embedding_raster(spark, sf_dir)
    s = e.select("image_id", "y", "x", (F.col("v") / QR).alias("sc"), ((F.col("x") + 1) / 8.0).alias("sa"))
    d = e.select((F.col("image_id") - 1).alias("image_id"), "y", "x", (F.col("v") / QR).alias("dc"), ((F.col("y") + 1) / 8.0).alias("da"))
    return s.join(d, ["image_id", "y", "x"])


def frame_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, scene, y, x, v: vectors in lists of five, the frames of an animation."""
    e = embedding_raster(spark, sf_dir)
    return e.select(F.floor(F.col("image_id") / 5).cast("long").alias("image_id"), (F.col("image_id") % 5).cast("int").alias("scene"), "y", "x", "v")


#: The same rasters in DuckDB's SQL, for the oracles.
SQL = {
    "emb": "(SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, (CAST(embedding[i] AS DOUBLE) + 1e0) / 2e0 * 65535e0 AS v FROM embeddings, range(1, 65) t(i))",
    "ord": "(SELECT l_orderkey % 16 AS image_id, l_orderkey AS y, CAST(l_linenumber AS INT) AS x, l_quantity / 50e0 * 65535e0 AS r, l_discount * 10e0 * 65535e0 AS g, l_tax * 12.5e0 * 65535e0 AS b FROM lineitem)",
}
SQL["pair"] = f"(SELECT s.image_id, s.y, s.x, s.v / 65535e0 AS sc, (s.x + 1) / 8e0 AS sa, d.v / 65535e0 AS dc, (d.y + 1) / 8e0 AS da FROM {SQL['emb']} s JOIN {SQL['emb']} d ON d.image_id = s.image_id + 1 AND d.y = s.y AND d.x = s.x)"
SQL["frames"] = f"(SELECT image_id // 5 AS image_id, CAST(image_id % 5 AS INT) AS scene, y, x, v FROM {SQL['emb']})"
