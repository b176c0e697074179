"""Python stages take many whole images at a time."""

import numpy as np
import pyarrow as pa
import pytest

from tessera import stacks
from tessera.operators import effects
from tessera.sources import formats, images

SIZES = [(8, 8), (1, 5), (8, 8), (3, 2), (1, 1), (40, 30), (8, 8)]


def _pictures():
    r = np.random.default_rng(4)
    return {k: r.integers(0, 256, s) * 257.0 for k, s in zip([5, None, 7, 2**60 + 1, 2**60, 1, 0], SIZES, strict=True)}


def _pixels(spark, pictures):
    rows = [(k, int(y), int(x), float(a[y, x])) for k, a in pictures.items() for y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double").repartition(3, "y")


def _back(rows, v):
    out = {}
    for r in rows:
        out.setdefault(r.image_id, {})[r.y, r.x] = r[v]
    return out


@pytest.mark.parametrize("rows", [1, 7, 100, 5000])
def test_whole_images(rows):
    pictures = _pictures()
    key, y, x, v = zip(*((k, y, x, a[y, x]) for k, a in pictures.items() for y, x in np.ndindex(a.shape)), strict=True)
    t = pa.table({"image_id": pa.array(key, pa.int64()), "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "v": v})
    tables = list(stacks.whole_images(iter(t.to_batches(rows)), "image_id", 100))
    assert pa.concat_tables(tables).equals(t)
    of = [k for p in tables for k in p.column("image_id").unique().to_pylist()]
    assert of == list(pictures) and len(tables) > 1
    for p in tables:
        for ids, a in stacks.stacks(p, "image_id", ["v"], 100):
            assert len(a) == 1 or a[0].size * len(a) <= 100
            for k, own in zip(ids.to_pylist(), a[..., 0], strict=True):
                assert (own == pictures.pop(k)).all()
    assert not pictures


def test_thinning_takes_a_stack():
    a = np.random.default_rng(1).integers(0, 3, (50, 6, 7)) * 30000.0
    assert (effects.thinning(a) == np.stack([effects.thinning(x) for x in a])).all()


@pytest.mark.parametrize("name", ["thinning", "seam_carve", "clahe"])
def test_effects_of_many_sizes(spark, name):
    pictures = {k: a for k, a in _pictures().items() if min(a.shape) > 1}
    back = _back(effects.whole(_pixels(spark, pictures), effects.WHOLE[name]).collect(), "v")
    assert back == {k: dict(np.ndenumerate(effects.WHOLE[name](a))) for k, a in pictures.items()}


@pytest.mark.parametrize("kind", ["viff", "k", "c", "m", "tiff", "tiff_lzw", "icodib", "rgba", "pgm"])
def test_files_of_many_sizes(spark, kind):
    """A file without an id keeps the ids beside it whole."""
    pictures = _pictures()
    files = images.encode(_pixels(spark, pictures), kind).coalesce(1)
    back = _back(images.decode(files).collect(), "c0")
    want = {k: formats.decode(formats.encode(a[:, :, None], kind), kind, *a.shape)[:, :, 0] for k, a in pictures.items()}
    assert back == {k: dict(np.ndenumerate(a)) for k, a in want.items()}


def test_sizes_that_some_files_lack(spark):
    a = np.arange(6.0).reshape(2, 3, 1) * 257
    rows = [(1, "gray", 2, 3, formats.encode(a, "gray")), (2, None, None, None, formats.encode(a, "pgm")), (3, None, None, None, None)]
    files = spark.createDataFrame(rows, "image_id long, format string, height int, width int, content binary").coalesce(1)
    assert _back(images.decode(files).collect(), "c0") == {k: dict(np.ndenumerate(a[:, :, 0])) for k in (1, 2)}
