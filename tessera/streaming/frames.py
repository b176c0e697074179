"""Rasters as streams: files that arrive, frames by event time, and animations that are rendered as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources import images


def arriving_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of the image files that arrive under a path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return images.decode(files.selectExpr("xxhash64(path) as image_id", "content"))


def windowed_means(events: DataFrame, ts: str = "ts", v: str = "value", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean by key and tumbling window; what comes later than ``late`` after the newest event is left out."""
    by = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key)
    return by.agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean")).select(key, F.col("w.start").alias("start"), "n", "mean")


def coalesced(frames: DataFrame) -> DataFrame:
    """A stream of frames (image_id, scene, y, x, v; v null where a frame leaves a pixel alone) as full frames.

    The state is each image's canvas; frames of one image must arrive in order of their scenes.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        canvas = dict(zip(*state.get[:2], strict=True)) if state.exists else {}
        pdf = pd.concat(list(parts)).sort_values(["scene", "y", "x"])
        out = []
        for scene, frame in pdf.groupby("scene", sort=True):
            for y, x, v in frame[["y", "x", "v"]].itertuples(index=False):
                place = int(y) << 20 | int(x)
                if v is not None and v == v:
                    canvas[place] = float(v)
            out += [(key[0], int(scene), p >> 20, p & 0xFFFFF, v) for p, v in sorted(canvas.items())]
        state.update((list(canvas), list(canvas.values())))
        yield pd.DataFrame(out, columns=["image_id", "scene", "y", "x", "v"])

    return frames.groupBy("image_id").applyInPandasWithState(run, "image_id long, scene int, y int, x int, v double", "places array<long>, samples array<double>", "append", GroupStateTimeout.NoTimeout)
