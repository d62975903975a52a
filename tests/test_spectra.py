"""Samples of wavelength edges against numpy, the fit of planted arcs, and offsets from a function."""

import numpy as np

from loomsky.operators import prepare, spectral
from loomsky.operators.resample import gather_chunks

SIZE = 60


def cells(spark, wave):
    rows = [(y, x, float(wave[y, x])) for y in range(SIZE) for x in range(SIZE)]
    return spark.createDataFrame(rows, "det_y long, det_x long, bc double")


def edges_of(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values], "edge double")


def test_samples_equal_argmin_with_ties_and_gaps(spark):
    wave = np.random.default_rng(5).integers(0, 40, (SIZE, SIZE)).astype(float)
    wave[np.random.default_rng(6).random((SIZE, SIZE)) < 0.2] = np.nan
    wave[:, 7] = np.nan
    got = {(r.edge, r.det_x): r.det_y for r in spectral.edge_samples(cells(spark, wave), edges_of(spark, 3, 17.5, 55), size=SIZE, margin=20).collect()}
    expected = {}
    for e in (3.0, 17.5, 55.0):
        for x in range(SIZE):
            if x != 7 and not (e == 55 and 20 < x < SIZE - 20):
                expected[e, x] = int(np.nanargmin(np.abs(wave[:, x] - e)))
    assert got == expected


def test_planted_filter_comes_back(spark):
    y, x = np.mgrid[:SIZE, :SIZE]
    fit = spectral.fit_lvf(cells(spark, np.hypot(x - 30.0, y - 80.0)), edges_of(spark, 40, 50, 60), (25.0, 70.0), size=SIZE, margin=10)
    assert fit["wave_edges"] == [40, 50, 60] and abs(fit["xc"] - 30) < 1 and abs(fit["yc"] - 80) < 2
    assert np.allclose(fit["R"], [40, 50, 60], atol=2)


def arc(r, xc, yc, radius, low, high, n, noise):
    t = np.radians(r.uniform(low, high, n))
    return xc + radius * np.cos(t) + r.normal(0, noise, n), yc + radius * np.sin(t) + r.normal(0, noise, n)


def test_geometric_circles_of_short_noisy_arcs(spark):
    """Short arcs whose algebraic circles are too small; groups without a circle; points without a place."""
    planted = {g: (1000.0 + g, -500.0, 100.0 + 20 * g) for g in range(3)}
    r = np.random.default_rng(11)
    rows = []
    for g, (xc, yc, radius) in planted.items():
        rows += [(g, float(a), float(b)) for a, b in zip(*arc(r, xc, yc, radius, 70, 110, 2000, 3.0))]
    rows += [(7, float(i), 2.0 * i) for i in range(5)] + [(8, 1.0, 1.0), (8, 2.0, 1.0)] + [(0, None, 1.0), (0, float("nan"), 1.0), (None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "g int, x double, y double")
    found = {r.g: r for r in spectral.fit_circles(points, by=["g"]).collect()}
    algebraic = {r.g: r.radius for r in spectral.kasa(spectral.circle_sums(points.where("g < 3 and not isnan(x)"), by=["g"])).collect()}
    for g, (xc, yc, radius) in planted.items():
        f = found[g]
        assert f.converged and abs(f.radius - radius) < 0.5 * abs(algebraic[g] - radius) and abs(f.xc - xc) < 2
        x, y = (np.array(v) for v in zip(*[(a, b) for k, a, b in rows if k == g and a is not None and a == a]))
        d = np.hypot(x - f.xc, y - f.yc)
        assert abs(d.mean() - f.radius) < 1e-6 and abs(np.sqrt(((d - d.mean()) ** 2).mean()) - f.rms) < 1e-6
        for mx, my in ((1, 0), (-1, 0), (0, 1), (0, -1)):  # no centre nearby costs less
            assert np.hypot(x - f.xc - mx * 0.01, y - f.yc - my * 0.01).std() >= d.std()
    assert found.keys() == {0, 1, 2, 7, 8} and all(found[g].xc is None and not found[g].converged for g in (7, 8))


def test_joint_arcs_from_a_far_start(spark):
    r = np.random.default_rng(3)
    rows = [(e, float(a), float(b)) for e in range(3) for a, b in zip(*arc(r, 50.0, 400.0, 300.0 + 20 * e, 250, 290, 300, 0.1))]
    points = spark.createDataFrame(rows, "edge int, x double, y double")
    (xc, yc), radii = spectral.fit_arcs(points, (40.0, 5000.0))
    assert abs(xc - 50) < 1 and abs(yc - 400) < 2 and all(abs(radii[e] - 300 - 20 * e) < 2 for e in range(3))
    with np.testing.assert_raises(RuntimeError):
        spectral.fit_arcs(points, (40.0, 5000.0), rounds=2)


def test_offsets_by_a_function(spark):
    chunk_map = spark.createDataFrame([(y, x, x // 2) for y in range(4) for x in range(4)], "det_y long, det_x long, chunk long")
    offsets = spark.createDataFrame([(f, c, 10.0 * f + c) for f in (0, 1) for c in (0, 1)], "frame long, chunk long, value double")
    rows = [(f, y, x, y, x, x // 2, 100.0) for f in (0, 1) for y in range(4) for x in range(4)]
    obs = spark.createDataFrame(rows, "frame long, ref_y long, ref_x long, map_y long, map_x long, chunk long, value double")

    def surface(chunks, values):
        return gather_chunks(chunks, values).withColumnRenamed("value", "raster").drop("chunk")

    columns = ["frame", "ref_y", "ref_x", "value"]
    made = prepare.prepare(obs, offsets=offsets, chunk_map=chunk_map, offset_surface=surface).select(columns)
    assert sorted(map(tuple, made.collect())) == sorted((f, y, x, 100.0 - 10 * f - x // 2) for f in (0, 1) for y in range(4) for x in range(4))
