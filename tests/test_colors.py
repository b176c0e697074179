import pytest
from pyspark.sql import functions as F

from tessera.functions import colors

COLOUR = (0.545877, 0.966567, 0.463759)
#: Published values of that colour; angles and lightness on the scales of the publication.
GOLDEN = {
    "xyz": (0.470645, 0.730177, 0.288323), "lms": (0.611749, 0.910088, 0.294880), "lab": (88.456154, -54.671483, 51.662818), "luv": (88.456154, -51.330414, 76.405526), "lchab": (88.456154, 75.219797, 136.620717),
    "hsv": (110.200859, 0.520200, 0.966567), "hsl": (110.200859, 0.882623, 0.715163), "hsi": (111.244375, 0.295985, 0.658734),
    "ydbdr": (0.783460, -0.480932, 0.451670), "yiq": (0.783460, -0.089078, -0.245399), "ypbpr": (0.783460, -0.180419, -0.169461), "yuv": (0.783460, -0.157383, -0.208443), "rec601ycbcr": (0.783460, 0.319581, 0.330539),
}
SCALE = {"lab": (100, 100, 100), "luv": (100, 100, 100), "lchab": (100, 100, 360), "hsv": (360, 1, 1), "hsl": (360, 1, 1), "hsi": (360, 1, 1)}
SHIFT = {s: (0, -0.5, -0.5) for s in ("ydbdr", "yiq", "ypbpr", "yuv")}


@pytest.mark.parametrize("space", GOLDEN)
def test_published_values(spark, space):
    df = spark.createDataFrame([COLOUR], "r double, g double, b double")
    got = df.select(*(F.expr(e).alias(f"c{i}") for i, e in enumerate(colors.forward(space)))).first()
    for c, k, d, want in zip(got, SCALE.get(space, (1, 1, 1)), SHIFT.get(space, (0, 0, 0)), GOLDEN[space], strict=True):
        assert abs((c + d) * k - want) < 2e-4 * max(1, abs(want)), (space, tuple(got))


@pytest.mark.parametrize("space", [*colors.LINEAR, "rgb", "hsv", "hsl", "hwb", "xyz", "lab"])
def test_there_and_back(spark, space):
    df = spark.createDataFrame([COLOUR, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.2, 0.2, 0.9)], "r double, g double, b double")
    there = df.select("r", "g", "b", *(F.expr(e).alias(f"c{i}") for i, e in enumerate(colors.forward(space))))
    for r in there.select("r", "g", "b", *(F.expr(e).alias(f"b{i}") for i, e in enumerate(colors.inverse(space)))).collect():
        assert all(abs(r[i] - r[i + 3]) < 1e-6 for i in range(3))


def test_refuses():
    with pytest.raises(ValueError):
        colors.forward("nowhere")
    with pytest.raises(ValueError):
        colors.inverse("luv")
