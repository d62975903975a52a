"""The system and its solution: planted skies and offsets, and numpy's dense least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.operators import solver, system
from loomsky.plans.pipeline import Calibrator, Config, Mosaicker

NY, NX, CHUNKS, FRAMES = 3, 4, 2, 5


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(2)
    sky, off = r.normal(5, 2, (NY, NX)), r.normal(0, 1, (FRAMES, CHUNKS))
    chunk = lambda f, x: int(x > f % 3)  # noqa: E731  so that all offsets hang together
    rows = [(f, y, x, chunk(f, x), float(sky[y, x] + off[f, chunk(f, x)]), 1.0) for f in range(FRAMES) for y in range(NY) for x in range(NX)]
    df = spark.createDataFrame(rows, "frame long, ref_y long, ref_x long, chunk long, value double, weight double")
    return df, sky, off


def dense(a, b):
    a, b = a.collect(), {r.row: r.val for r in b.collect()}
    rows = {r: i for i, r in enumerate(sorted({x.row for x in a}))}
    n = max(x.col for x in a) + 1
    m, v = np.zeros((len(rows), n)), np.array([b.get(r, 0.0) for r in rows])
    for x in a:
        m[rows[x.row], x.col] += x.val
    return m, v


@pytest.mark.parametrize("method", ["lsqr", "lsmr"])
@pytest.mark.parametrize("precondition", [True, False])
def test_equals_the_dense_solution(planted, method, precondition):
    df, _, _ = planted
    cal = Calibrator(df, NY, NX, CHUNKS).setup(damp_weight=1e-3)
    m, v = dense(cal.a, cal.b)
    expected = np.linalg.lstsq(m, v, rcond=None)[0]
    found = cal.apply(method=method, atol=1e-12, btol=1e-12, iterations=40, precondition=precondition)
    x = np.zeros(len(expected))
    for r in found.x.collect():
        x[r.col] = r.value
    assert np.allclose(m @ x, m @ expected, atol=1e-5)
    assert all(b <= a * (1 + 1e-6) for a, b in zip(found.residuals, found.residuals[1:]))


def test_planted_offsets_come_back(planted, spark):
    df, sky, off = planted
    cal = Calibrator(df, NY, NX, CHUNKS).setup(damp_weight=1e-8)
    first = cal.apply(atol=1e-12, btol=1e-12, iterations=40)
    got = np.zeros_like(off)
    for r in cal.offsets().collect():
        got[r.frame, r.chunk] = r.value
    shift = (got - off).mean()
    assert np.allclose(got - off, shift, atol=1e-3)
    again = cal.apply(resume=True, atol=1e-12, btol=1e-12, iterations=5)
    assert again.residual <= first.residual * 1.01  # what is left is the damping rows


def test_damping_is_about_x0(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "row long, col long, val double")
    b = spark.createDataFrame([(0, 3.0), (1, 4.0)], "row long, val double")
    x0 = spark.createDataFrame([(0, 1.0), (1, 1.0)], "col long, value double")
    for method in ("lsqr", "lsmr"):
        found = solver.solve(a, b, method=method, x0=x0, damp=2.0, precondition=False, atol=1e-12, btol=1e-12)
        got = {r.col: r.value for r in found.x.collect()}
        assert got[0] == pytest.approx((3 + 4 * 1) / 5, abs=1e-6) and got[1] == pytest.approx((8 + 4 * 1) / 8, abs=1e-6)
    with pytest.raises(ValueError):
        solver.solve(a, b, method="cg")


def test_shared_pixels_rows_outside_and_nan(spark):
    rows = [(0, 0, 0, 0, 2.0, 1.0, 0.25), (0, 0, 0, 1, 2.0, 1.0, 0.75), (0, 9, 0, 0, 1.0, 1.0, 1.0), (0, 0, 1, 0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "frame long, ref_y long, ref_x long, chunk long, value double, weight double, share double")
    cal = Calibrator(df, 1, 2, 2).setup()
    assert sorted((r.col, r.val) for r in cal.a.collect()) == [(0, 1.0), (2, 0.25), (3, 0.75)]
    assert [r.val for r in cal.b.collect()] == [2.0]


def test_regularisation_mean_and_empty(planted, spark):
    df, _, _ = planted
    pairs = spark.createDataFrame([(0, 1)], "chunk_i long, chunk_j long")
    means = spark.createDataFrame([(f, 0.5) for f in range(FRAMES)], "frame long, value double")
    cal = Calibrator(df, NY, NX, CHUNKS).setup(adjacency=pairs, reg_weight=0.1, mean_offsets=means, damp_weight=0.1)
    n = NY * NX * FRAMES
    assert cal.a.select("row").distinct().count() == n + FRAMES + FRAMES + NY * NX
    empty = Calibrator(df.limit(0), NY, NX, CHUNKS).setup()
    assert empty.a.isEmpty() and empty.b.isEmpty()


def test_outliers_with_no_spread(spark):
    df = spark.createDataFrame([(0, 1.0)] * 5 + [(0, 2.0), (0, float("nan"))], "frame int, value double")
    got = sorted((str(r.value), r.is_outlier) for r in system.outliers(df, 3.0).collect())
    assert got == [("1.0", False)] * 5 + [("2.0", True), ("nan", False)]


def test_dense_rows_have_no_gaps(spark):
    df = spark.createDataFrame([(f, i) for f in (3, 1, 7) for i in range(f)], "frame int, i int")
    rows = system.dense_rows(df, "frame", ["i"]).orderBy("frame", "i").collect()
    assert [r.row for r in rows] == list(range(11))


def test_round_trip_of_columns(spark):
    sky = spark.createDataFrame([(1, 2, 5.0)], "ref_y long, ref_x long, value double")
    off = spark.createDataFrame([(3, 1, 7.0)], "frame long, chunk long, value double")
    x = solver.columns_of(sky, off, NX, NY * NX, CHUNKS)
    s, o = solver.sky_and_offsets(x, NX, NY * NX, CHUNKS)
    assert [tuple(r) for r in s.collect()] == [(1, 2, 5.0)] and [tuple(r) for r in o.collect()] == [(3, 1, 7.0)]


def test_whole_job(planted, spark, tmp_path):
    df, sky, off = planted
    config = Config(f"file://{tmp_path}", "run1")
    cal = Calibrator(df, NY, NX, CHUNKS, config).setup(damp_weight=1e-8)
    cal.apply(atol=1e-12, btol=1e-12, iterations=40)
    chunk_map = spark.createDataFrame([(0, x, x % CHUNKS) for x in range(NX)], "det_y long, det_x long, chunk long")
    cal.save(spark.createDataFrame([(f,) for f in range(FRAMES)], "frame long"), chunk_map)
    mos = Mosaicker(spark, config).load_calibration()
    maps = mos.make(df.drop("weight"), sigma=3.0, unit="MJy/sr")
    assert {r.map_name for r in maps.select("map_name").distinct().collect()} == {"mean_map", "std_map", "sc_mean_map"}
    got = np.zeros((NY, NX))
    for r in maps.where("map_name = 'sc_mean_map'").collect():
        got[r.ref_y, r.ref_x] = r.data
    assert np.allclose(got - sky, (got - sky).mean(), atol=1e-3)
    extra = maps.where("map_name = 'mean_map'").withColumn("data", F.lit(1.0))
    mos.append(extra.unionByName(extra.withColumn("map_name", F.lit("wav_mean_map"))))
    mos.save()
    stored = spark.read.parquet(config.mosaic_path)
    assert stored.where("map_name = 'MEAN_MAP' and data = 1.0").count() == NY * NX and stored.where("map_name = 'WAV_MEAN_MAP'").count() == NY * NX
    with pytest.raises(ValueError):
        Config("x", "a/b")
