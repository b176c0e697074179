"""Whole images in the Python stages: many small ones at a time, stacked by their size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pixels of images that are worked on at a time; a larger image comes alone.
AT_ONCE = 1 << 16


def by_image(df: DataFrame, key: str) -> DataFrame:
    """The rows of an image after one another, in one task."""
    return df.repartition(key).sortWithinPartitions(key)


def _begins(keys: pa.Array) -> np.ndarray:
    """Whether a row's key is another than that of the row before; nulls are one key."""
    null = keys.is_null().to_numpy(zero_copy_only=False)
    value = keys.fill_null(0).to_numpy(zero_copy_only=False)
    return np.append(True, (value[1:] != value[:-1]) | (null[1:] != null[:-1]))


def whole_images(batches: Iterator[pa.RecordBatch], key: str, at_once: int = AT_ONCE) -> Iterator[pa.Table]:
    """Tables of whole images, of about at_once rows or one larger image. The rows come image by image."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        new = np.flatnonzero(_begins(keys))
        if not held or keys[0].as_py() == held[-1].column(key)[-1].as_py():
            new = new[1:]
        if size + batch.num_rows >= at_once and len(new):
            cut = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def stacks(table: pa.Table, key: str, values: list[str], at_once: int = AT_ONCE) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The keys of images of one size, and their samples: images x height x width x values, 0 where a pixel lacks and NaN where it is null."""
    keys = table.column(key).combine_chunks()
    new = _begins(keys)
    begins, image = np.flatnonzero(new), np.cumsum(new) - 1
    y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    v = np.stack([table.column(c).to_numpy().astype(np.float64) for c in values], axis=1)
    size = np.stack([np.maximum.reduceat(a, begins) + 1 for a in (y, x)], axis=1)
    for h, w in np.unique(size, axis=0).tolist():
        members = np.flatnonzero((size == (h, w)).all(axis=1))
        most = max(1, at_once // max(1, h * w))
        for at in range(0, len(members), most):
            some = members[at : at + most]
            place = np.full(len(begins), -1)
            place[some] = np.arange(len(some))
            of = place[image]
            own = of >= 0
            a = np.zeros((len(some), h, w, len(values)))
            a[of[own], y[own], x[own]] = v[own]
            yield keys.take(pa.array(begins[some])), a
