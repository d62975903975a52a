"""The cache in the order of the sky: boxes of its files, and boxes and cones read from the files that meet them."""

import pytest
from pyspark.sql import functions as F

from loomsky.functions.geometry import Frame, separation
from loomsky.sources import tiled

FRAME = Frame((30.0, 10.0), (33.0, 33.0), ((-0.01, 0.0), (0.0, 0.01)), 64, 64)


@pytest.fixture(scope="module")
def cache(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tiled')}/cache"
    cells = spark.range(64 * 64).select(F.col("id").alias("frame"), F.expr("id div 64").alias("ref_y"), F.expr("id % 64").alias("ref_x"), (F.col("id") % 3).cast("double").alias("weight"))
    hot = spark.range(3000).select(F.col("id").alias("frame"), F.lit(5).cast("long").alias("ref_y"), F.lit(6).cast("long").alias("ref_x"), F.lit(1.0).alias("weight"))
    odd = spark.createDataFrame([(1, None, 2, 1.0), (1, 2, 2, None)], "frame long, ref_y long, ref_x long, weight double")
    obs = cells.union(hot).union(odd)
    return obs, tiled.write_tiled(obs, path, files=12, tile=8), path


def test_rows_boxes_and_a_hot_place(spark, cache):
    obs, rows, path = cache
    assert rows.count() == obs.where("weight <> 0 and ref_y is not null").count()
    boxes = spark.read.parquet(f"{path}/boxes").collect()
    assert sum(b.n for b in boxes) == rows.count() and len(boxes) > 8
    assert max(b.n for b in boxes) < 0.3 * rows.count()  # the hot place, 3 of 5 thousand rows, is split


def test_a_box_opens_the_files_that_meet_it(spark, cache):
    obs, rows, path = cache
    for box in ((0, 7, 0, 7), (20, 40, 50, 63), (13, 13, 0, 63)):
        got = tiled.read_box(spark, path, *box)
        inside = F.col("ref_y").between(*box[:2]) & F.col("ref_x").between(*box[2:])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, obs.where("weight <> 0").where(inside).collect()))
        assert len(got.inputFiles()) < len(rows.inputFiles())
    assert tiled.read_box(spark, path, 100, 200, 0, 5).isEmpty()


def test_cones(spark, cache):
    obs, rows, path = cache
    at = FRAME.sky(F.col("ref_x").cast("double"), F.col("ref_y").cast("double"))
    for ra, dec, radius in ((30.2, 10.1, 0.09), (29.8, 9.8, 0.13), (30.0, 10.0, 0.0)):
        got = tiled.read_cone(spark, path, FRAME, ra, dec, radius)
        expected = rows.where(separation(*at, F.lit(ra), F.lit(dec)) < radius)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
        assert radius == 0 or (expected.count() and len(got.inputFiles()) < len(rows.inputFiles()))
    with pytest.raises(ValueError):
        tiled.cone_box(spark, FRAME, 210.0, -10.0, 1.0)
    with pytest.raises(ValueError):
        tiled.cone_box(spark, FRAME, 30.0, 10.0, 60.0)
