import numpy as np
import pytest

from tessera.operators import channels, geometry, virtual

QR = 65535.0


def raster(spark, a, image=1):
    return spark.createDataFrame([(image, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "image_id int, y int, x int, v double")


def grid(df, y0=0, x0=0, v="v"):
    rows = df.collect()
    out = np.full((max(r.y for r in rows) - y0 + 1, max(r.x for r in rows) - x0 + 1), np.nan)
    for r in rows:
        out[r.y - y0, r.x - x0] = r[v]
    return out


A = np.arange(12.0).reshape(3, 4) ** 2


@pytest.mark.parametrize(("method", "mode"), [("edge", "edge"), ("tile", "wrap"), ("mirror", "symmetric"), ("background", "constant")])
def test_views_as_padded(spark, method, mode):
    want = np.pad(A, ((5, 6), (7, 5)), mode, **({"constant_values": 9.0} if mode == "constant" else {}))
    assert (grid(virtual.view(raster(spark, A), -5, -7, 14, 16, method, 9.0), -5, -7) == want).all()


def test_random_takes_pixels_of_the_image(spark):
    one, again = (grid(virtual.view(raster(spark, A), -2, -2, 7, 8, "random"), -2, -2) for _ in range(2))
    assert (one == again).all() and set(one.ravel()) <= set(A.ravel()) and (one[2:5, 2:6] == A).all()


def test_views_of_images_of_two_sizes(spark):
    both = raster(spark, A).union(raster(spark, A[:2, :2], 2))
    out = virtual.view(both, 0, 4, 1, 1, "tile").collect()
    assert {r.image_id: r.v for r in out} == {1: A[0, 0], 2: A[0, 0]}
    assert virtual.view(both.limit(0), 0, 0, 2, 2, "tile").count() == 0
    with pytest.raises(ValueError):
        virtual.view(both, 0, 0, 1, 1, "nowhere")


@pytest.mark.parametrize("method", [*virtual.INTERPOLATE, "mesh"])
def test_interpolation_keeps_planes_and_constants(spark, method):
    flat = raster(spark, np.full((5, 5), 7.0))
    points = spark.createDataFrame([(1, 0, 0, 1.3, 2.8), (1, 0, 1, -3.0, 9.0)], "image_id int, y int, x int, py double, px double")
    assert [round(r.v, 9) for r in virtual.interpolate(flat, points, method).collect()] == [7.0, 7.0]
    if method in ("bilinear", "mesh", "catrom", "spline"):  # these keep slopes
        y, x = np.mgrid[:7, :7]
        points = spark.createDataFrame([(1, 0, 0, 2.3, 3.8)], "image_id int, y int, x int, py double, px double")
        assert virtual.interpolate(raster(spark, 3.0 * y + 5.0 * x), points, method).head().v == pytest.approx(3 * 2.3 + 5 * 3.8)


def test_selectors():
    assert channels.chosen("RGB") == ("r", "g", "b") and channels.chosen("alpha, Red") == ("r", "a") and channels.chosen("K") == ()
    assert channels.chosen("black", ("c", "m", "y", "k")) == ("k",)
    for bad in ("purple", "", "r,,b"):
        with pytest.raises(ValueError):
            channels.chosen(bad)


def test_alpha_that_was_off(spark):
    df = spark.createDataFrame([(1, 0, 0, 10.0, 20.0, 30.0, 5.0)], "image_id int, y int, x int, r double, g double, b double, a double")
    assert {m: channels.alpha_mode(df, m, blended=False).head().a for m in ("on", "set", "activate", "remove")} == {"on": QR, "set": QR, "activate": 5.0, "remove": 5.0}
    assert {channels.alpha_mode(df, m).columns == df.columns for m in channels.ALPHA_MODES} == {True}


def test_gravity_of_odd_sizes(spark):
    out = {g: grid(geometry.gravity_crop(raster(spark, A), g, 2, 1)).tolist() for g in ("center", "south_east", "north")}
    assert out == {"center": [A[1, 1:3].tolist()], "south_east": [A[2, 2:4].tolist()], "north": [A[0, 1:3].tolist()]}
