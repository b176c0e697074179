from tessera.core import embedding_raster
from tessera.operators import regions

D = "/root/testdata/sf0.001"


def test_both_ways_label_alike(spark):
    df = embedding_raster(spark, D).where("image_id < 12")
    for connectivity in (4, 8):
        ways = [sorted(map(tuple, regions.components(df, "v > 33000", connectivity, held=held).collect())) for held in (regions.HELD_PIXELS, 0)]
        assert ways[0] == ways[1] and len(ways[0]) == 12 * 64
    assert regions.components(df.limit(0), "v > 0").count() == 0


def test_small_images_beside_large_ones(spark):
    df = embedding_raster(spark, D).where("image_id < 6 and (image_id > 2 or y < 2)")
    ways = [sorted(map(tuple, regions.components(df, "v > 33000", held=held).collect())) for held in (regions.HELD_PIXELS, 20, 0)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == 3 * 64 + 3 * 16


def test_images_in_pieces(spark, monkeypatch):
    df = embedding_raster(spark, D).where("image_id < 40").coalesce(1)
    want = sorted(map(tuple, regions.components(df, "v > 33000").collect()))
    monkeypatch.setattr(regions, "AT_ONCE", 100)
    assert sorted(map(tuple, regions.components(df, "v > 33000").collect())) == want
