import numpy as np
import pytest

from tessera.core import embedding_raster
from tessera.functions import fx
from tessera.plans.plan import Crop, Curve, Kernel, Plan, gaussian_plan
from tessera.sources import codecs
from tessera.streaming import frames

D = "/root/testdata/sf0.001"


def grid(df):
    return {(r.image_id, r.y, r.x): r.v for r in df.collect()}


def test_rewrites_keep_results(spark):
    df = embedding_raster(spark, D).where("image_id < 4")
    plan = Plan(8, 8).curve("negate").curve("gamma", gamma=2.2).convolve([[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 1.0]]).curve("level", black=1000.0, white=900000.0, gamma=1.2).crop(2, 1, 4, 6).convolve([[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]).crop(3, 2, 2, 3)
    plain, fast = grid(plan.run(df, False)), grid(plan.run(df))
    inside = {k for k in plain if 3 <= k[1] < 5 and 3 <= k[2] < 5}  # beyond the first crop there are no pixels to gather
    assert set(fast) == set(plain) and all(abs(fast[k] - plain[k]) < 1e-6 * max(1, abs(plain[k])) for k in inside)


def test_rewrites():
    plan = gaussian_plan(8, 8, 1, 1.0).curve("negate").curve("solarize", at=100.0).crop(2, 2, 3, 3).optimized().steps
    assert isinstance(plan[0], Crop) and (plan[0].y0, plan[0].y1) == (1, 6)
    assert [type(s) for s in plan[1:]] == [Kernel, Kernel, Curve, Crop]
    k1, k2 = np.array(plan[1].weights), np.array(plan[2].weights)
    assert k1.shape == (1, 3) and k2.shape == (3, 1)


def test_fx_refuses():
    for text in ("for(a,b,c)", "1 +", "nothing(2)", "unknown", "(1", "1 $ 2"):
        with pytest.raises(ValueError):
            fx.Compiler(text, {}).program()


def test_arriving_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pgm").write_bytes(codecs.FORMATS["pgm"][2](np.full((2, 3, 1), i * 25700.0)))
    means = frames.arriving_images(spark, str(tmp_path / "in")).groupBy("image_id").avg("c0")
    q = means.writeStream.format("memory").queryName("arriving").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r[1] for r in spark.table("arriving").collect()) == [0.0, 25700.0, 51400.0]


def test_windowed_means(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{D}/events.parquet*")
    q = frames.windowed_means(stream, width="1 day", late="1000 days").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.event_type, r.start): r.n for r in spark.table("windowed").collect()}
    assert got == {(r.event_type, r.start): r.n for r in frames.windowed_means(events, width="1 day").collect()} and sum(got.values()) == events.count()


def test_coalesced(spark, tmp_path):
    rows = [(1, 0, 0, 0, 5.0), (1, 0, 0, 1, 6.0), (1, 1, 0, 0, None), (1, 1, 0, 1, 7.0), (1, 2, 0, 0, 8.0), (2, 0, 0, 0, 1.0)]
    kind = "image_id long, scene int, y int, x int, v double"
    for i, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
        q = frames.coalesced(spark.readStream.schema(kind).parquet(str(tmp_path / "frames"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, 0, 0, 0, 5.0), (1, 0, 0, 1, 6.0), (1, 1, 0, 0, 5.0), (1, 1, 0, 1, 7.0), (1, 2, 0, 0, 8.0), (1, 2, 0, 1, 7.0), (2, 0, 0, 0, 1.0)]
