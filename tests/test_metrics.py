from pyspark.sql import functions as F

from tessera.core import embedding_raster
from tessera.operators import metrics


def test_templates_of_any_size(spark, monkeypatch):
    """A template in several parts is found where it was cut out."""
    image = embedding_raster(spark, "/root/testdata/sf0.001").where("image_id < 3")
    template = image.where("image_id = 1 and y between 2 and 6 and x between 3 and 5").select((F.col("y") - 2).alias("y"), (F.col("x") - 3).alias("x"), "v")
    out = []
    for cells in (4096, 4):
        monkeypatch.setattr(metrics, "CELLS", cells)
        out.append(sorted((r.image_id, r.y, r.x, round(r.error, 3)) for r in metrics.best_offset(image, template).collect()))
    assert out[0] == out[1] and out[0][1] == (1, 2, 3, 0.0) and len(out[0]) == 3
