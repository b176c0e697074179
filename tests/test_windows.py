"""Neighbourhoods keep a pixel one row, and look beyond missing pixels."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import windows
from tessera.queries import QUERIES

D = "/root/testdata/sf0.001"


def _rows(node):
    """The rows that each operator of an executed plan made."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _rows(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _rows(node.plan())
    else:
        made = node.metrics().get("numOutputRows")
        if made.isDefined():
            yield made.get().value()
        for i in range(node.children().size()):
            yield from _rows(node.children().apply(i))


@pytest.mark.parametrize("name", [*(f"morphology_{m}_{s}" for m in ("dilate", "erode") for s in ("disk", "octagon", "ring", "intensity")), "morphology_open_intensity", "morphology_close_intensity", "statistic_mode", "convolve_binomial", "shade"])
def test_a_pixel_stays_one_row(spark, name):
    df = QUERIES[name](spark, D)
    pixels = len(df.collect())
    assert pixels == 32000 and max(_rows(df._jdf.queryExecution().executedPlan())) == pixels


@pytest.fixture(scope="module")
def holed(spark):
    r = random.Random(2)
    rows = [(i, y, x, r.randint(0, 6) * 8000.0) for i in range(12) for y in range(r.randint(1, 7)) for x in range(r.randint(1, 7)) if i < 2 or r.random() < 0.5]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double").cache(), rows


def _near(rows, cells):
    """Per pixel the samples at the offsets, those beyond an edge at the edge."""
    at = {r[:3]: r[3] for r in rows}
    h, w = ({i: 1 + max(r[k] for r in rows if r[0] == i) for i, *_ in rows} for k in (1, 2))
    for i, y, x, _ in rows:
        places = [(i, max(0, min(h[i] - 1, y + dy)), max(0, min(w[i] - 1, x + dx))) for dy, dx, *_ in cells]
        if found := [at[p] for p in places if p in at]:
            yield (i, y, x), found


@pytest.mark.parametrize("shape", ["plus", "cross", "diamond", "disk", "octagon", "ring"])
def test_missing_pixels(spark, holed, shape):
    df, rows = holed
    cells = windows.SHAPES[shape]
    for f, best in ((windows.dilate, max), (windows.erode, min)):
        assert {tuple(r)[:3]: r.v for r in f(df, cells).collect()} == {k: best(n) for k, n in _near(rows, cells)}
    mode = lambda n: min(n, key=lambda v: (-n.count(v), v))
    assert {tuple(r)[:3]: r.v for r in windows.statistic(df, "mode").collect()} == {k: mode(n) for k, n in _near(rows, windows.rectangle(3, 3))}
    grey = df.select("image_id", "y", "x", *(F.col("v").alias(c) for c in "rgb"))
    assert {tuple(r)[:3]: r.r for r in windows.by_intensity(grey, "dilate", shape).collect()} == {k: max(n) for k, n in _near(rows, cells)}


def test_rectangles():
    assert windows._rectangles(windows.disk(2.5)) == [(1, 1, 2, 2), (2, 2, 1, 1)]
    assert windows._rectangles(windows.rectangle(4, 2)) == [(1, 0, 2, 1)]
    assert windows._rectangles(windows.SHAPES["cross"]) is None and windows._rectangles(windows.SHAPES["ring"]) is None and windows._rectangles([]) is None
