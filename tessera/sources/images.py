"""Image files in Spark: files to pixels and back. Bytes come from Spark's own reader, so any store that it reads will do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.stacks import by_image, stacks, whole_images

from . import formats

PIXELS = "image_id long, y int, x int, c0 double, c1 double, c2 double, c3 double"
IMAGES = "image_id long, format string, height int, width int, channels int, content binary"


#: Pixels that are passed on at a time: of a large file a part, of small ones many.
STRIP = 1 << 18


def decode(files: DataFrame, image_id: str = "image_id", content: str = "content") -> DataFrame:
    """Pixels of each file (c0 to c3, those that an image lacks null). A null file, or one of an unknown format, has none.

    The format is told by the first bytes; where these don't say it, or the size isn't in the file, the columns
    format, height and width do, as encode() gives them.
    """
    hints = [c for c in ("format", "height", "width") if c in files.columns]

    def pixels(held: list[tuple]) -> pa.RecordBatch:
        ids, y, x, parts = zip(*held, strict=True)
        size = [len(p) for p in parts]
        of = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(size)), size)))
        samples = [pa.array(np.concatenate([p[:, i] if i < p.shape[1] else np.full(len(p), np.nan) for p in parts]), from_pandas=True) if any(i < p.shape[1] for p in parts) else pa.nulls(sum(size), pa.float64()) for i in range(4)]
        return pa.RecordBatch.from_arrays([of, pa.array(np.concatenate(y), pa.int32()), pa.array(np.concatenate(x), pa.int32()), *samples], names=["image_id", "y", "x", "c0", "c1", "c2", "c3"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                own, data, *hint = (c[i].as_py() for c in batch.columns)
                row = dict(zip(hints, hint, strict=True))
                kind = None if data is None else row.get("format") or formats.kind_of(data)
                if kind is None:
                    continue
                a = formats.decode(data, kind, row.get("height") or 0, row.get("width") or 0)
                h, w, n = a.shape
                flat, step = a.reshape(h * w, n), max(1, STRIP // max(1, w)) * w
                for at in range(0, h * w, step):
                    part = flat[at : at + step]
                    y, x = np.divmod(np.arange(at, at + len(part)), w)
                    held.append((own, y, x, part))
                    size += len(part)
                    if size >= STRIP:
                        yield pixels(held)
                        held, size = [], 0
        if held:
            yield pixels(held)

    return files.select(image_id, content, *hints).mapInArrow(run, PIXELS)


def encode(pixels: DataFrame, kind: str, channels: tuple[str, ...] = ("v",), key: str = "image_id") -> DataFrame:
    """One file per image; an image is one value, so one task writes it, with others beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_images(batches, key):
            for ids, a in stacks(table, key, list(channels)):
                n, *size = a.shape
                files = pa.array([formats.encode(x, kind) for x in a], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([kind] * n), *(pa.array([s] * n, pa.int32()) for s in size), files], names=["image_id", "format", "height", "width", "channels", "content"])

    return by_image(pixels.select(key, "y", "x", *channels), key).mapInArrow(run, IMAGES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, image_id (a hash of it) and content of the files under a path."""
    return spark.read.format("binaryFile").load(path).selectExpr("path", "xxhash64(path) as image_id", "content")


def ping(files: DataFrame) -> DataFrame:
    """image_id, size and the format by its first bytes: no file is decoded."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"image_id": part["image_id"], "size": part["size"], "format": [formats.kind_of(bytes(b)) for b in part["head"]]})

    return files.selectExpr("image_id", "cast(length(content) as long) as size", "substring(content, 1, 16) as head").mapInPandas(run, "image_id long, size long, format string")
