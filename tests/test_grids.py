"""Resampling, splines, spectra and geometry against numpy and known shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.functions import geometry
from loomsky.operators import chunks, prepare, reproject, resample, spectral, splines, tiles


def raster(spark, values):
    rows = [(y, x, float(values[y, x])) for y in range(values.shape[0]) for x in range(values.shape[1])]
    return spark.createDataFrame(rows, "det_y long, det_x long, raster double")


def test_bilinear_inside_on_the_edge_and_outside(spark):
    v = np.arange(12.0).reshape(3, 4)
    t = spark.createDataFrame([(0, 1.25, 1.5), (1, 2.5, 0.0), (2, 9.0, 9.0), (3, float("nan"), 0.0), (4, 2.0, 3.0)], "id int, map_y double, map_x double")
    got = {r.id: r.raster for r in resample.bilinear(t, raster(spark, v), ["id"]).collect()}
    assert got[0] == pytest.approx(4 * 1.25 + 1.5) and got[1] == pytest.approx(0.5 * 8) and got[2] == 0 and got[3] == 0 and got[4] == 11


def test_corner_weights_sum_to_one(spark):
    t = spark.createDataFrame([(i, 0.1 * i, 0.37 * i) for i in range(9)], "id int, map_y double, map_x double")
    met = tiles.corners(t, raster(spark, np.ones((3, 4))), ["raster"])
    assert all(r.w == pytest.approx(1) for r in met.rows.select(sum(met.weights).alias("w")).collect())


def test_upscaling_keeps_corners(spark):
    v = np.array([[0.0, 2.0], [4.0, 6.0]])
    got = {(r.det_y, r.det_x): r.raster for r in resample.upscale2d(raster(spark, v), 2, 2, 3, 3).collect()}
    assert got == {(y, x): 2.0 * y + x for y in range(3) for x in range(3)}


def test_adjacency_of_descending_pairs(spark):
    g = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (0, 2, -1), (1, 0, 2), (1, 1, 1), (1, 2, 0)], "det_y long, det_x long, chunk long")
    assert {tuple(r) for r in chunks.chunk_adjacency(g).collect()} == {(1, 2), (0, 1)}
    assert chunks.chunk_adjacency(g, strict=True).isEmpty()


def test_single_run_gives_no_bins(spark):
    s = spark.createDataFrame([(0, i, 7) for i in range(4)] + [(1, i, v) for i, v in enumerate([1, 1, 2, 2, 2, 3])], "g int, i int, v int")
    assert [tuple(r) for r in chunks.run_bins(s, ["g"], ["i"], "v").collect()] == [(1, 2, 5, 1.5, 3.0, 2)]


@pytest.mark.parametrize("kind", ["pchip", "akima", "cubic"])
@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_splines_keep_means(spark, kind, n):
    r = np.random.default_rng(n)
    edges, means = np.cumsum(r.uniform(0.5, 2, n + 1)), r.normal(3, 1, n)
    bins = spark.createDataFrame([(0, float(a), float(b), float(m)) for a, b, m in zip(edges, edges[1:], means)], "g int, low double, high double, mean double")
    nodes = [(1 - math.sqrt(0.6)) / 2, 0.5, (1 + math.sqrt(0.6)) / 2]  # Gauss's rule is exact for the cubics' slopes
    at = [splines.mean_preserving(F.col("low") + (F.col("high") - F.col("low")) * t) for t in nodes]
    got = splines.edge_slopes(bins, ["g"], kind).orderBy("low").select(((5 * at[0] + 8 * at[1] + 5 * at[2]) / 18).alias("m")).collect()
    assert np.allclose([x.m for x in got], means)


def test_cubic_is_exact_for_polynomials():
    edges = np.array([0, 1, 2.5, 3, 4.5, 6])
    integral = np.polynomial.Polynomial([1, 2, -1, 0.5])
    means = np.diff(integral(edges)) / np.diff(edges)
    assert np.allclose(splines.cubic_slopes(edges, means), integral.deriv()(edges))
    assert np.allclose(splines.weights(edges, np.linspace(0, 6, 9)) @ means, integral.deriv()(np.linspace(0, 6, 9)))


def test_surface_keeps_means_and_fills(spark):
    r = np.random.default_rng(0)
    v = r.normal(5, 1, (4, 3))
    rows = [(1, y, x, float(v[y, x])) for y in range(4) for x in range(3)] + [(2, y, x, 0.0) for y in range(4) for x in range(3)]
    df = spark.createDataFrame(rows, "frame int, sub int, col int, value double")
    got = splines.surface(df, factor=8).toPandas()
    assert set(got.frame) == {1}
    means = got.groupby([got.y.astype(int), got.x.astype(int)]).value.mean().to_numpy().reshape(4, 3)
    assert np.allclose(means, v, atol=0.05)


@pytest.mark.parametrize("fill", [False, True])
def test_surface_is_the_product_of_its_lines(spark, fill):
    r = np.random.default_rng(1)
    grids = {f: np.where(r.random((5, 4)) < (0.7 if fill else 1), r.normal(3, 1, (5, 4)), 0.0) for f in range(3)} | {8: np.pad(r.normal(3, 1, (1, 2)), 1)}
    df = spark.createDataFrame([(f, y + 7, x, float(v)) for f, g in grids.items() for (y, x), v in np.ndenumerate(g)], "frame int, sub int, col int, value double")
    got = {(w.frame, w.y, w.x): w.value for w in splines.surface(df, factor=3, fill=fill).collect()}
    want = {}
    for f, g in grids.items():
        ys, xs = np.nonzero(g)
        g = (splines.fill_grid(g) if fill else g)[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
        py, px = ((np.arange(n * 3) + 0.5) / 3 for n in g.shape)
        v = splines.weights(np.arange(g.shape[0] + 1.0), py) @ g @ splines.weights(np.arange(g.shape[1] + 1.0), px).T
        want |= {(f, round(y + ys.min() + 7, 9), round(x + xs.min(), 9)): v[i, j] for i, y in enumerate(py) for j, x in enumerate(px)}
    assert {(f, round(y, 9), round(x, 9)): v for (f, y, x), v in got.items()} == pytest.approx(want, abs=1e-9)


def test_filling_by_masks(spark):
    r = np.random.default_rng(6)
    masks = [r.random((4, 6)) < 0.6, r.random((4, 6)) < 0.2, np.zeros((4, 6), bool), np.ones((4, 6), bool)]
    grids = {f: np.where(masks[f % 4], r.normal(5, 1, (4, 6)), 0.0) for f in range(12)}
    df = spark.createDataFrame([(f, y + f, x - 3, float(v), "k") for f, g in grids.items() for (y, x), v in np.ndenumerate(g)], "frame int, sub int, col int, value double, more string")
    got = splines.fill_linear(df)
    assert got.columns == df.columns
    want = {(f, y + f, x - 3): v for f, g in grids.items() for (y, x), v in np.ndenumerate(splines.fill_grid(g))}
    assert {(w.frame, w.sub, w.col): w.value for w in got.collect()} == pytest.approx(want)


def test_filling_a_plane_is_exact_inside_and_nearest_outside():
    y, x = np.mgrid[0:5, 0:6]
    plane = 10 + 2.0 * y + 3.0 * x
    holed = plane.copy()
    holed[2, 2:4] = holed[1, 4] = 0
    assert np.allclose(splines.fill_grid(holed), plane)
    line = np.array([[0, 4.0, 0, 0], [0, 5.0, 0, 6.0]])
    line[1] = 0
    assert splines.fill_grid(line)[1].tolist() == [4.0] * 4
    assert (splines.fill_grid(np.zeros((2, 2))) == 0).all() and (splines.fill_grid(plane) == plane).all()


def test_linear_is_clamped(spark):
    k = spark.createDataFrame([(0, 1.0, 10.0), (0, 3.0, 30.0)], "g int, x double, y double")
    t = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 2.5), (0, 3.0), (0, 9.0)], "g int, x double")
    assert [r.y for r in splines.linear(k, t, ["g"]).orderBy("x").collect()] == [10, 10, 25, 30, 30]


def test_joint_arcs(spark):
    r = np.random.default_rng(5)
    rows = [(e, float(x), float(9000 - math.sqrt((8000 + 100 * e) ** 2 - (x - 1000) ** 2) + r.normal(0, 0.01))) for e in range(4) for x in range(0, 2040, 20)]
    df = spark.createDataFrame(rows, "edge int, x double, y double")
    (xc, yc), radii = spectral.fit_arcs(df, (1020.0, 9600.0))
    assert xc == pytest.approx(1000, abs=1) and yc == pytest.approx(9000, abs=10) and radii[3] - radii[0] == pytest.approx(300, abs=1)
    sums = spectral.kasa(spectral.circle_sums(df.where("edge = 0"), by=["edge"])).first()
    assert sums.radius == pytest.approx(8000, rel=0.02)
    with pytest.raises(ValueError):
        spectral.fit_arcs(df.limit(0), (0.0, 0.0))


def test_spectrum_bracketing(spark):
    df = spark.createDataFrame([([0.0, 10.0, 30.0], [1.0, 2.0, 4.0])], "data array<double>, wave array<double>")
    got = df.select(*[spectral.at_wavelength(F.col("data"), F.col("wave"), F.lit(t)) for t in (1.5, 3.0, 0.5, 5.0)]).first()
    assert list(got) == [5.0, 20.0, -5.0, 40.0]


def test_histogram_matches_numpy(spark):
    v = np.random.default_rng(3).uniform(0, 1, 200).tolist() + [1.0, 0.0, 2.0]
    got = {r.bin: r.density for r in spectral.histogram(spark.createDataFrame([(x,) for x in v], "v double"), "v", 0.0, 1.0, 8).collect()}
    expected, _ = np.histogram(v, bins=8, range=(0, 1), density=True)
    assert np.allclose([got.get(i, 0) for i in range(8)], expected)


def test_tangent_plane_round_trip(spark):
    df = spark.createDataFrame([(float(a), float(d)) for a in (0.5, 120, 359) for d in (-60, 0, 85)], "ra double, dec double")
    frame = geometry.Frame((120.0, 40.0), (51.0, 41.0), ((-0.01, 0.002), (0.002, 0.01)), 80, 100)
    near = df.where(geometry.separation(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(40.0)) < 80)
    x, y = frame.pixel(F.col("ra"), F.col("dec"))
    ra, dec = frame.sky(F.col("x"), F.col("y"))
    for r in near.withColumns({"x": x, "y": y}).select("ra", "dec", ra.alias("a"), dec.alias("d")).collect():
        assert r.a == pytest.approx(r.ra, abs=1e-8) and r.d == pytest.approx(r.dec, abs=1e-8)
    assert frame.padded(5).ny == 90 and frame.upscaled(2).crpix == (102.0, 82.0)
    assert near.count() < df.count()


def test_optimal_frame_holds_its_corners(spark):
    df = spark.createDataFrame([(10.0, 5.0), (10.4, 5.0), (10.0, 5.3), (10.4, 5.3)], "ra double, dec double")
    frame = geometry.optimal_frame(df, 36.0, pad=2)
    x, y = frame.pixel(F.col("ra"), F.col("dec"))
    rows = df.select(x.alias("x"), y.alias("y")).collect()
    assert all(1.9 <= r.x <= frame.nx - 2.9 and 1.9 <= r.y <= frame.ny - 2.9 for r in rows)
    with pytest.raises(ValueError):
        geometry.optimal_frame(df.limit(0), 36.0)


def test_reprojection_of_an_aligned_exposure(spark):
    frame = geometry.Frame((30.0, 10.0), (11.0, 11.0), ((-0.01, 0.0), (0.0, 0.01)), 21, 21)
    exposure = spark.createDataFrame([(7, 30.0, 10.0, 3.0, 3.0, -0.01, 0.0, 0.0, 0.01)], "frame int, ra0 double, dec0 double, px double, py double, cd11 double, cd12 double, cd21 double, cd22 double")
    rows = [(7, y, x, float(10 * y + x), 1 if (y, x) == (2, 2) else 0) for y in range(7) for x in range(7)]
    pixels = spark.createDataFrame(rows, "frame int, det_y long, det_x long, value double, dq long")
    got = {(r.ref_y, r.ref_x): r for r in reproject.interpolated(exposure, pixels, frame, 12).collect()}
    assert got[10, 10].value == pytest.approx(33.0, abs=1e-6) and got[9, 9].dq == 1 and got[12, 12].dq == 0
    areas = {(r.ref_y, r.ref_x): r for r in reproject.exact(exposure, pixels.drop("dq"), frame).collect()}
    assert areas[10, 10].value == pytest.approx(33.0, abs=1e-3) and areas[10, 10].foot == pytest.approx(1.0, abs=1e-4)
    assert sum(r.foot for r in areas.values()) == pytest.approx(49, abs=0.01)


def test_preparation_order(spark):
    rows = [(0, 0, 0, 5.0, 0, 0.0, 0.0, 0), (0, 0, 1, 6.0, 1, 0.0, 1.0, 1), (0, 0, 2, float("nan"), 0, 0.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "frame int, ref_y int, ref_x int, value double, dq long, map_y double, map_x double, chunk long")
    offsets = spark.createDataFrame([(0, 0, 2.0)], "frame int, chunk long, value double")
    weights = spark.createDataFrame([(0, 0, 0.5), (0, 1, 1.0)], "det_y long, det_x long, weight double")
    got = prepare.prepare(df, offsets=offsets, grid_weight=weights, preprocess=lambda d: d.withColumn("value", F.col("value") + 1), postprocess=lambda d: d.withColumn("weight", F.col("weight") * 2))
    assert {(r.ref_x, r.value, r.weight) for r in got.collect()} == {(0, 4.0, 1.0), (2, 0.0, 0.0)}


def test_shares_of_chunks(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0, 0.5)], "frame int, ref_y int, ref_x int, map_y double, map_x double")
    cells = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, -1)], "det_y long, det_x long, chunk long")
    assert {(r.chunk, r.share) for r in prepare.chunk_shares(df, cells).collect()} == {(0, 0.5), (1, 0.5)}


def test_radial_function_keeps_means_of_arcs(spark):
    offsets = spark.createDataFrame([(1, c, float(v)) for c, v in enumerate([9, 2, 4, 3, 8])], "frame int, chunk int, value double")
    radii = [10.0, 12.0, 14.0, 16.0]
    rows = [(c, radii[c - 1] + (i + 0.5) / 100) for c in (1, 2, 3) for i in range(200)]
    pixels = spark.createDataFrame(rows, "chunk int, r double")
    for kind in ("pchip", "akima", "cubic"):
        got = splines.radial(offsets, radii, pixels, kind=kind).groupBy("chunk").agg(F.avg("value").alias("m")).collect()
        assert {r.chunk: round(r.m, 3) for r in got} == {1: 2.0, 2: 4.0, 3: 3.0}


def test_smoothed_runs_keep_their_means(spark):
    values = [5] * 3 + [1] * 40 + [2] * 30 + [0] * 50 + [7] * 2
    s = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "g int, i int, v int")
    got = splines.by_runs(s, ["g"], "i", "v").collect()
    assert len(got) == len(values) and all((r.smooth is None) == (r.v in (5, 7)) for r in got)
    for v in (1, 2, 0):
        assert np.mean([r.smooth for r in got if r.v == v]) == pytest.approx(v, abs=0.01)
