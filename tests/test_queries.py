import pytest

from tessera.queries import QUERIES

POINTS = {(1, 1): 10000.0, (6, 2): 50000.0, (3, 6): 30000.0}


@pytest.mark.parametrize("method", ["shepards", "inverse", "voronoi"])
def test_sparse_color_meets_its_points(spark, method):
    """Each image has the three points' values at their pixels, whatever queries are registered after these."""
    rows = QUERIES[f"sparse_color_{method}"](spark, "/root/testdata/sf0.001").collect()
    at = [(r.x, r.y, r.v) for r in rows if (r.x, r.y) in POINTS]
    assert len(at) == 3 * len({r.image_id for r in rows}) > 0
    assert all(abs(v - POINTS[x, y]) < 1 for x, y, v in at)
