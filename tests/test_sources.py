"""Sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from loomsky.functions.geometry import Frame
from loomsky.operators.coadd import coadd_mean
from loomsky.schemas import schema
from loomsky.sources import readers, sinks
from loomsky.streaming import coadd as stream

from .conftest import SF


def test_lists_and_indices(spark, tmp_path):
    (tmp_path / "list.csv").write_text(" /a/exp_0002_det_05.h5 ,x\n\n/a/exp_0001_det_10.h5\nnot,one\n")
    files = readers.numbered(readers.exposure_list(spark, str(tmp_path / "list.csv")))
    got = {r.file_path: (r.frame, r.i.exp, r.i.det) for r in files.withColumn("i", readers.exposure_index(F.col("file_path"))).collect()}
    assert got == {"/a/exp_0001_det_10.h5": (0, 1, 10), "/a/exp_0002_det_05.h5": (1, 2, 5), "not": (2, None, None)}
    two = readers.union_sorted(files.select("file_path"), files.select("file_path").limit(0))
    assert [r.file_path for r in two.collect()] == sorted(got)


def test_directory(spark, tmp_path):
    for n in ("a_1.dat", "b_2.dat", "a_3.txt"):
        (tmp_path / n).write_text("x")
    assert {r.file_path.rsplit("/", 1)[1] for r in readers.directory(spark, str(tmp_path), "a_").collect()} == {"a_1.dat", "a_3.txt"}


def test_frames_are_skipped_or_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/frames"
    one = spark.createDataFrame([(1, 0, 5.0), (2, 0, 6.0)], "frame int, ref_y int, value double")
    sinks.write_frames(one.where("frame = 1"), path)
    sinks.write_frames(one.withColumn("value", F.col("value") + 1), path)
    assert {(r.frame, r.value) for r in spark.read.parquet(path).collect()} == {(1, 5.0), (2, 7.0)}
    sinks.write_frames(one.where("frame = 1").withColumn("value", F.lit(9.0)), path, replace_existing=True)
    assert {(r.frame, r.value) for r in spark.read.parquet(path).collect()} == {(1, 9.0), (2, 7.0)}
    seen = readers.frames(spark, path, ["frame", "value", "dq"])
    assert seen.where("dq is null").count() == 2
    listed = readers.with_missing(spark.createDataFrame([(1,), (3,)], "frame int"), seen)
    assert {(r.frame, r.is_missing) for r in listed.collect()} == {(1, False), (3, True)}
    assert readers.readable(listed).count() == 1


def test_instrument_tables(spark, tmp_path):
    base = f"file://{tmp_path}"
    frame = Frame((1.0, 2.0), (3.0, 4.0), ((-1.0, 0.0), (0.0, 1.0)), 5, 6)
    sinks.write_reference_frame(spark, frame, f"{base}/ref")
    assert readers.reference_frame(spark, f"{base}/ref") == frame
    params = {"xc": 1.0, "yc": 2.0, "R": [3.0], "wave_edges": [4.0]}
    assert readers.lvf_params(spark, f"{base}/none") is None
    sinks.write_lvf_params(spark, params, f"{base}/lvf")
    assert readers.lvf_params(spark, f"{base}/lvf") == params
    with pytest.raises(ValueError):
        readers.band_tables(spark, str(tmp_path), 4)
    from loomsky.operators.spectral import channel_edges

    table = spark.createDataFrame([(4, 2.0, 3.0), (4, 1.0, 2.0), (5, 9.0, 9.5)], "band int, lmin double, lmax double")
    assert channel_edges(table, 4) == [1.0, 2.0, 3.0] and channel_edges(table, 6) == []
    with pytest.raises(KeyError):
        schema("nothing")


def test_headers(spark):
    df = spark.createDataFrame([("a", {"RA": "1.5"}), ("b", {})], "file_path string, header map<string,string>")
    assert [(r.file_path, r.ra) for r in readers.headers(df, ["RA"]).collect()] == [("a", 1.5)]
    with pytest.raises(ValueError):
        readers.headers(df, ["DEC"])


def test_gain_and_paths(spark):
    obs = spark.createDataFrame([(0, 0, 4.0), (0, 1, 4.0)], "det_y int, det_x int, value double")
    old = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.0)], "det_y int, det_x int, gain double")
    got = sinks.recalibrated_gain(obs, old, old.withColumn("gain", F.lit(3.0)))
    assert {(r.det_x, r.value) for r in got.collect()} == {(0, 6.0), (1, None)}
    paths = spark.createDataFrame([("/a/b.x",), ("/c/a/b.x",)], "file_path string")
    assert [r[0] for r in paths.select(sinks.remapped(F.col("file_path"), "/a/", "/n/")).collect()] == ["/n/b.x", "/c/a/b.x"]


def test_streamed_coadd_equals_the_batch(spark, tmp_path):
    obs = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.expr("l_partkey div 50").alias("ref_y"), F.expr("l_partkey % 50").alias("ref_x"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("weight")
    )
    for k in range(3):
        obs.where(F.expr(f"ref_x % 3 = {k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.running_sums(source).writeStream.format("memory").queryName("sums").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.ref_y, r.ref_x): r.data for r in stream.maps(spark.table("sums")).collect()}
    expected = {(r.ref_y, r.ref_x): r.data for r in coadd_mean(obs).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_windowed_sums_merge(spark):
    rows = [(f"2024-01-0{d} 00:00:00", 0, 0, float(d), 1.0) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "t string, ref_y int, ref_x int, value double, weight double").withColumn("t", F.to_timestamp("t"))
    r = stream.maps(stream.merged(stream.windowed_sums(df, "t", "1 day", "1 hour"))).first()
    assert r.data == 2.0 and r.weight == 3.0


def test_several_tasks_number_a_list(spark):
    paths = [f"/d/{(i * 7919) % 5000:05d}" for i in range(5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = readers.numbered(spark.createDataFrame([(p,) for p in paths], "file_path string")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.file_path for r in sorted(got, key=lambda r: r.frame)] == sorted(paths) and sorted(r.frame for r in got) == list(range(5000))
    assert len({r.task for r in got}) > 1
