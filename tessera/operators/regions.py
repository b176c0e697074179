"""Regions and clusters: connected components, fills, line votes, palettes and spectra.

Components of images that a task can hold are labelled in numpy, one image per group; those of larger ones by
label propagation with shortcuts, all DataFrame joins, one written table per round. Spectra need a whole image at
once.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _kept(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder of spark.checkpoint.dir and read again; on a cluster that must be set."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", df.sparkSession.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or _own_folder()
    path = f"{folder}/raster-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder of this machine, where the session names none, as in tests."""
    return tempfile.mkdtemp(prefix="tessera-")


#: Pixels of an image that one task labels.
HELD_PIXELS = 1 << 22


#: Pixels of whole images that are labelled at a time.
AT_ONCE = 1 << 18


def _labels(image: np.ndarray, y: np.ndarray, x: np.ndarray, value: np.ndarray, diagonal: bool) -> np.ndarray:
    """The place of the first pixel of each pixel's component, by minima over neighbours and shortcuts; pixels lie by image, y and x."""
    n = len(y)
    new_row = np.ones(n, bool)
    new_row[1:] = (image[1:] != image[:-1]) | (y[1:] != y[:-1])
    row, begins = np.cumsum(new_row) - 1, np.flatnonzero(new_row)
    wide = int(x.max()) - int(x.min()) + 3
    at = row * wide + (x - x.min() + 1)
    below = np.zeros(len(begins), bool)  # whether the next row is the one below
    below[:-1] = (image[begins[1:]] == image[begins[:-1]]) & (y[begins[1:]] == y[begins[:-1]] + 1)
    edges = []
    for dy, dx in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else []):
        target = at + dy * wide + dx
        there = np.minimum(np.searchsorted(at, target), n - 1)
        ok = (at[there] == target) & (value[there] == value) & (below[row] if dy else True)
        edges.append(np.stack([np.flatnonzero(ok), there[ok]]))
    a, b = np.concatenate(edges, axis=1)
    parent = np.arange(n)
    while True:
        before = parent.copy()
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        parent = parent[parent]
        if (parent == before).all():
            return parent


def _labelled(flat: DataFrame, diagonal: bool, key: str) -> DataFrame:
    """Images by whole images: as many at a time as have AT_ONCE pixels; a task holds one image or those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def label(t: pa.Table) -> pa.Table:
            image, y, x, value = (t.column(c).to_numpy() for c in (key, "y", "x", "value"))
            y, x = y.astype(np.int64), x.astype(np.int64)
            image = np.cumsum(np.append(True, image[1:] != image[:-1]))
            first = _labels(image, y, x, value, diagonal)
            return t.append_column("label", pa.array((y[first] << 20) + x[first]))

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                t = pa.Table.from_batches(held)
                images = t.column(key).to_numpy()
                cut = int(np.flatnonzero(np.append(True, images[1:] != images[:-1]))[-1])  # where the last image begins
                if cut:
                    yield from label(t.slice(0, cut)).to_batches()
                held, size = t.slice(cut).to_batches(), t.num_rows - cut
        if size:
            yield from label(pa.Table.from_batches(held)).to_batches()

    return flat.repartition(key).sortWithinPartitions(key, "y", "x").mapInArrow(run, flat.withColumn("label", F.lit(0).cast("long")).schema)


def components(df: DataFrame, value: str, connectivity: int = 4, key: str = "image_id", held: int = HELD_PIXELS) -> DataFrame:
    """Pixels with label: the least (y, x), as y * 2^20 + x, of the connected pixels of one value. Values aren't null, x is below 2^20.

    Images of at most ``held`` pixels are labelled by whole images in numpy, larger ones by label propagation.
    """
    flat = df.select(key, "y", "x", F.expr(value).alias("value"))
    large = flat.groupBy(key).count().where(F.col("count") > held).select(key)
    if not large.limit(1).count():
        return _labelled(flat, connectivity == 8, key)
    small = _labelled(flat.join(large, key, "left_anti"), connectivity == 8, key)
    return small.union(_propagated(flat.join(large, key, "left_semi"), connectivity, key).select(small.columns))


def _propagated(flat: DataFrame, connectivity: int, key: str) -> DataFrame:
    own = flat.select(key, "y", "x", F.col("value").alias("k"), (F.col("y").cast("long") * (1 << 20) + F.col("x")).alias("id"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    cells = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps))
    near = own.select(key, "k", F.col("id").alias("a"), "y", "x", F.explode(cells).alias("c")).select(key, "k", "a", (F.col("y") + F.col("c.dy")).alias("y"), (F.col("x") + F.col("c.dx")).alias("x"))
    links = near.join(own.select(key, "y", "x", "k", F.col("id").alias("b")), [key, "y", "x", "k"]).select(key, "a", "b")
    links = _kept(links.union(links.select(key, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = _kept(own.select(key, "id", F.col("id").alias("label")))
    while True:
        best = links.join(labels.select(key, F.col("id").alias("b"), "label"), [key, "b"]).groupBy(key, F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(best, [key, "id"], "left").select(key, "id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = step.select(key, F.col("id").alias("label"), F.col("label").alias("further"))
        now = _kept(step.join(jump, [key, "label"]).select(key, "id", "old", F.least("label", "further").alias("label")))
        labels = now.drop("old")
        if not now.where("old <> label").limit(1).count():
            return own.join(labels, [key, "id"]).select(key, "y", "x", F.col("k").alias("value"), "label")


def objects(labelled: DataFrame, key: str = "image_id") -> DataFrame:
    """Box, area and centroid of each component."""
    return labelled.groupBy(key, "label").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def floodfill(df: DataFrame, value: str, y: int, x: int, fill: float, connectivity: int = 4, key: str = "image_id") -> DataFrame:
    """The pixels connected with (y, x) get the fill."""
    labelled = components(df, value, connectivity, key)
    seed = labelled.where((F.col("y") == y) & (F.col("x") == x)).select(key, F.col("label").alias("seed"))
    return df.join(labelled.select(key, "y", "x", "label"), [key, "y", "x"]).join(seed, key, "left").withColumn("v", F.when(F.col("label") == F.col("seed"), fill).otherwise(F.col("v"))).drop("label", "seed")


def hough(edges: DataFrame, angles: int = 180, key: str = "image_id") -> DataFrame:
    """Votes by angle and distance; each edge pixel votes once per angle, summed before the shuffle."""
    each = edges.select(key, "y", "x", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("theta"))
    turn = F.col("theta") * (math.pi / angles)
    return each.groupBy(key, "theta", F.floor(F.round(F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn), 9) + 0.5).cast("int").alias("rho")).agg(F.count(F.lit(1)).alias("votes"))


def remap(df: DataFrame, palette: list[tuple[float, float, float]]) -> DataFrame:
    """The index and colour of the nearest palette entry, the first of equals; the palette rides along as a constant."""
    far = [(F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b) for r, g, b in palette]
    best = F.array_min(F.array(*(F.struct(F.round(d, 6).alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far))))
    return df.withColumn("index", best["i"])


def kmeans(df: DataFrame, centres: list[tuple[float, float, float]], rounds: int = 3) -> list[tuple[float, float, float]]:
    """Moves the centres to the means of their pixels; each round sends one row per centre to the driver."""
    for _ in range(rounds):
        means = {r["index"]: (r["r"], r["g"], r["b"]) for r in remap(df, centres).groupBy("index").agg(*(F.avg(c).alias(c) for c in "rgb")).collect()}
        centres = [means.get(i, c) for i, c in enumerate(centres)]
    return centres


def quantize(df: DataFrame, bits: int = 2, key: str = "image_id") -> DataFrame:
    """Each pixel takes the mean colour of its cell of the colour cube, ``bits`` deep."""
    cell = [F.least(F.floor(F.col(c) / 65536.0 * (1 << bits)), F.lit((1 << bits) - 1)).alias(f"q{c}") for c in "rgb"]
    cells = df.select("*", *cell)
    means = cells.groupBy(key, "qr", "qg", "qb").agg(*(F.avg(c).alias(f"m{c}") for c in "rgb"), F.count(F.lit(1)).alias("n"))
    return cells.join(means, [key, "qr", "qg", "qb"]).withColumns({c: F.col(f"m{c}") for c in "rgb"}).drop("qr", "qg", "qb", "mr", "mg", "mb", "n")


def spectrum(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Magnitude and phase of each image's discrete Fourier transform; an image is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        grid = np.zeros((h, w))
        grid[pdf["y"], pdf["x"]] = pdf["v"] / 65535.0
        f = np.fft.fft2(grid) / (h * w)
        y, x = np.divmod(np.arange(h * w), w)
        return pd.DataFrame({key: pdf[key].iloc[0], "y": y.astype("int32"), "x": x.astype("int32"), "magnitude": np.abs(f).ravel(), "phase": (np.angle(f) / (2 * np.pi) + 0.5).ravel()})

    return df.select(key, "y", "x", "v").groupBy(key).applyInPandas(run, f"{key} long, y int, x int, magnitude double, phase double")


def inverse_spectrum(df: DataFrame, key: str = "image_id") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        grid = np.zeros((h, w), complex)
        grid[pdf["y"], pdf["x"]] = pdf["magnitude"] * np.exp(2j * np.pi * (pdf["phase"] - 0.5))
        v = np.real(np.fft.ifft2(grid) * (h * w)) * 65535.0
        y, x = np.divmod(np.arange(h * w), w)
        return pd.DataFrame({key: pdf[key].iloc[0], "y": y.astype("int32"), "x": x.astype("int32"), "v": v.ravel()})

    return df.groupBy(key).applyInPandas(run, f"{key} long, y int, x int, v double")


def local_peaks(votes: DataFrame, least: int, key: str = "image_id") -> DataFrame:
    """The strongest line of each image with enough votes."""
    return votes.where(F.col("votes") >= least).withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("votes"), "theta", "rho"))).where("k = 1").drop("k")
