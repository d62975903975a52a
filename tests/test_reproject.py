"""Reprojection: homographies against angles, areas and kernels against loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.functions.geometry import Frame
from loomsky.operators import reproject
from loomsky.plans.pipeline import Config, Reprojector

PLACE = "frame int, ra0 double, dec0 double, px double, py double, cd11 double, cd12 double, cd21 double, cd22 double"
REF = Frame((30.0, 60.0), (21.0, 16.0), ((-0.010, 0.001), (0.001, 0.011)), 32, 40)
#: turned, squeezed and mirrored, finer and coarser than the reference frame
EXPOSURES = [
    (1, 30.05, 60.02, 5.5, 4.0, -0.007, 0.004, 0.0045, 0.008), (2, 29.9, 59.97, 6.0, 5.0, 0.02, 0.003, -0.004, 0.025), (3, 30.1, 60.05, 4.0, 4.0, -0.003, 0.0, 0.0, 0.02),
]
NY, NX = 10, 12


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(2)
    data = {(f, y, x): (float(rng.normal(10, 3)), int(rng.choice([0, 0, 0, 1, 6, 1 << 31]))) for f, *_ in EXPOSURES for y in range(NY) for x in range(NX)}
    pixels = spark.createDataFrame([(*k, *v, "clash") for k, v in data.items()], "frame int, det_y int, det_x int, value double, dq long, foot string")
    exposures = spark.createDataFrame(EXPOSURES, PLACE)
    return exposures, pixels.drop("foot"), data, {r.frame: r for r in reproject.placements(exposures, REF, 30).collect()}


def matrix(r, name):
    return np.array([r[f"{name}{i}"] for i in range(9)]).reshape(3, 3)


def through(m, y, x):
    X, Y, W = m @ np.array([x, y, 1.0])
    return Y / W, X / W


def test_homographies_are_the_mapping(spark, case):
    exposures, _, _, placed = case
    points = exposures.crossJoin(spark.createDataFrame([(y, x) for y in (0.0, 7.5, 31.0) for x in (0.0, 11.25, 39.0)], "ref_y double, ref_x double"))
    back = reproject.to_reference(reproject.to_detector(points, REF), REF, y="map_y", x="map_x")
    for r in back.collect():
        h, g = matrix(placed[r.frame], "h"), matrix(placed[r.frame], "g")
        assert through(h, r.ref_y, r.ref_x) == pytest.approx((r.map_y, r.map_x), abs=1e-7)
        assert through(g, r.map_y, r.map_x) == pytest.approx((r.ref_y, r.ref_x), abs=1e-9) == (r.ref_fy, r.ref_fx)


def masks(data, f, y, x):
    y0, x0 = math.floor(y), math.floor(x)
    four = [((f, y0 + a, x0 + b), (y - y0 if a else 1 - y + y0) * (x - x0 if b else 1 - x + x0)) for a in (0, 1) for b in (0, 1)]
    return sum(1 << bit for bit in range(32) if sum(w for k, w in four if k in data and data[k][1] >> bit & 1) > 0.01), four


def checked(got, want, data, placed):
    """Values and feet are as wanted, places those of the mapping, masks interpolated."""
    rows = {(r.frame, r.ref_y, r.ref_x): r for r in got.collect()}
    assert set(rows) == set(want) and len(rows) > 300
    for k, r in rows.items():
        at = through(matrix(placed[r.frame], "h"), r.ref_y, r.ref_x)
        assert (r.map_y, r.map_x) == pytest.approx(at, abs=1e-9) and r.dq == masks(data, r.frame, *at)[0]
        assert (r.value, r.foot) == pytest.approx(want[k], abs=1e-7)


def squares(placed, f, width):
    r = placed[f]
    return [(y, x) for y in range(max(0, r._oy), min(REF.ny, r._oy + width)) for x in range(max(0, r._ox), min(REF.nx, r._ox + width))]


def test_interpolation(case):
    exposures, pixels, data, placed = case
    want = {}
    for f, *_ in EXPOSURES:
        for y, x in squares(placed, f, 30):
            met = [(w, data[k][0]) for k, w in masks(data, f, *through(matrix(placed[f], "h"), y, x))[1] if k in data and w > 0]
            if met:
                want[f, y, x] = sum(w * v for w, v in met), sum(w for w, _ in met)
    checked(reproject.interpolated(exposures, pixels, REF, 30), want, data, placed)


def cut(poly, y, x):
    """Area of a polygon inside a unit cell, side by side (Sutherland and Hodgman)."""
    for axis, edge, sign in ((0, y - 0.5, 1), (0, y + 0.5, -1), (1, x - 0.5, 1), (1, x + 0.5, -1)):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            a, b = sign * (p[axis] - edge), sign * (q[axis] - edge)
            out += [p] if a >= 0 else []
            out += [tuple(p[i] + a / (a - b) * (q[i] - p[i]) for i in (0, 1))] if a * b < 0 else []
        poly = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2 if poly else 0.0


def test_exact_areas(case):
    exposures, pixels, data, placed = case
    parts, whole = {}, 0.0
    for (f, y, x), (v, _) in data.items():
        quad = [through(matrix(placed[f], "g"), y + a, x + b) for a, b in ((-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5))]
        for yy, xx in squares(placed, f, 30):
            if abs(yy - quad[0][0]) < 6 and abs(xx - quad[0][1]) < 6 and (a := cut(quad, yy, xx)) > 1e-9:
                s = parts.setdefault((f, yy, xx), [0.0, 0.0])
                s[0], s[1], whole = s[0] + a * v, s[1] + a, whole + a
    got = reproject.exact(exposures, pixels, REF, 30)
    checked(got, {k: (s / a, a) for k, (s, a) in parts.items()}, data, placed)
    assert got.agg(F.sum("foot")).first()[0] == pytest.approx(whole) and max(a for _, a in parts.values()) == pytest.approx(1)


def test_overlap_of_cells_and_edges(spark):
    quads = {
        "same": [(-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5)], "far": [(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (6.0, 5.0)], "quarter": [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)],
        "over": [(-9.0, -9.0), (-9.0, 9.0), (9.0, 9.0), (9.0, -9.0)], "diamond": [(-0.5, 0.0), (0.0, 0.5), (0.5, 0.0), (0.0, -0.5)], "touch": [(0.5, -0.5), (0.5, 0.5), (1.5, 0.5), (1.5, -0.5)],
        "turned": [(0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)], "line": [(0.0, -1.0), (0.0, 1.0), (0.0, 1.0), (0.0, -1.0)],
    }
    rows = [(k, 0, 0, *[v for p in q for v in p]) for k, q in quads.items()]
    df = spark.createDataFrame(rows, "k string, ref_y int, ref_x int, y0 double, x0 double, y1 double, x1 double, y2 double, x2 double, y3 double, x3 double")
    got = {r.k: r._a for r in reproject.with_overlap(df, [(f"y{i}", f"x{i}") for i in range(4)]).collect()}
    assert got == pytest.approx({"same": 1, "far": 0, "quarter": 0.25, "over": 1, "diamond": 0.5, "touch": 0, "turned": 1, "line": 0})


@pytest.mark.parametrize("conserve", [False, True])
def test_adaptive_kernels(case, conserve):
    exposures, pixels, data, placed = case
    want, width = {}, 1.3
    for f, *_ in EXPOSURES:
        h = matrix(placed[f], "h")
        for y, x in squares(placed, f, 30):
            p, step = np.array(through(h, y, x)), 1e-4
            j = np.array([(np.array(through(h, y + step, x)) - through(h, y - step, x)) / (2 * step), (np.array(through(h, y, x + step)) - through(h, y, x - step)) / (2 * step)]).T
            u, s, vt = np.linalg.svd(j)
            back = np.linalg.inv(u @ np.diag(np.maximum(s, 1)) @ vt)
            total = weight = 0.0
            for yy in range(NY):
                for xx in range(NX):
                    r2 = float(((back @ (p - (yy, xx))) ** 2).sum())
                    if r2 <= 4:
                        w = math.exp(-2 * r2 / width**2)
                        total, weight = total + w * data[f, yy, xx][0], weight + w
            foot = weight / (np.prod(np.maximum(s, 1)) * math.pi * width**2 / 2 * (1 - math.exp(-8 / width**2)))
            if foot >= 0.5:
                want[f, y, x] = total / weight * (abs(np.linalg.det(j)) if conserve else 1), foot
    checked(reproject.adaptive(exposures, pixels, REF, 30, conserve_flux=conserve), want, data, placed)


def test_flux_of_a_planted_source(spark):
    """A source on a turned, finer detector: its pixels' sum is kept by the adaptive method, and by areas."""
    exposure = spark.createDataFrame([(1, 30.0, 60.0, 20.0, 20.0, -0.004, 0.003, 0.003, 0.004)], PLACE)
    rows = [(1, y, x, math.exp(-((y - 19) ** 2 + (x - 22) ** 2) / 18)) for y in range(41) for x in range(41)]
    pixels = spark.createDataFrame(rows, "frame int, det_y int, det_x int, value double")
    flux = sum(r[3] for r in rows)
    got = reproject.adaptive(exposure, pixels, REF, dq=None, conserve_flux=True, least_foot=0.01).agg(F.sum("value")).first()[0]
    assert got == pytest.approx(flux, rel=0.01)
    areas = reproject.exact(exposure, pixels, REF, dq=None).agg(F.sum(F.col("value") * F.col("foot"))).first()[0]
    assert areas * 0.00011 / 0.000025 == pytest.approx(flux, rel=0.01)  # a reference pixel has 4.36 of the detector's


def test_null_and_missing_pixels(spark, case):
    exposures, pixels, _, _ = case
    holes = pixels.withColumn("value", F.when(F.expr("det_y = 3 and det_x = 3"), F.lit(math.nan)).otherwise(F.col("value"))).where("not (det_y = 7 and det_x = 7)")
    for method in reproject.METHODS.values():
        got = method(exposures, holes, REF, 30)
        assert 0 < got.where("isnan(value)").count() < got.count() and got.where("foot is null or value is null").isEmpty()
        assert method(exposures, pixels.limit(0), REF, 30).isEmpty() and method(exposures.limit(0), pixels, REF, 30).isEmpty()


def test_pixels_are_not_shuffled(spark, case, tmp_path):
    exposures, pixels, _, _ = case
    pixels.write.parquet(f"{tmp_path}/pixels")
    stored = spark.read.parquet(f"{tmp_path}/pixels")
    for method in reproject.METHODS.values():
        plan = method(exposures, stored, REF, 30, dq=None)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
        # small enough for generated code, and one exchange, of sums by reference pixel
        assert max(map(len, plan.splitlines())) < 20_000
        assert plan.count("Exchange hashpartitioning(frame") == 1 and "partial_sum" in plan


def test_methods_of_the_job(spark, case, tmp_path):
    exposures, pixels, _, _ = case
    for method in reproject.METHODS:
        job = Reprojector(spark, Config(str(tmp_path), f"run_{method}"))
        job.run(exposures, pixels, REF, 30, method=method)
        first = job.frames().count()
        job.run(exposures, pixels, REF, 30, method=method)  # what is stored stays
        assert job.frames().count() == first > 300 and {"map_y", "map_x", "dq", "foot"} <= set(job.frames().columns)
    with pytest.raises(ValueError, match="adaptive"):
        job.run(exposures, pixels, REF, 30, method="other")


def test_places_keep_their_digits_far_from_the_first_pixel(spark):
    frame = Frame((30.0, 10.0), (31.0, 21.0), ((-0.016, 0.0), (0.0, 0.016)), 1_000_000, 60)
    exposure = spark.createDataFrame([(1, 30.0, 10.0, 20.5137, 10.2571, -0.01, 0.0, 0.0, 0.01)], PLACE)
    rows = spark.range(3, 40_000, 7).select(F.lit(1).alias("frame"), F.col("id").cast("int").alias("det_y"), F.lit(20).alias("det_x"), F.lit(1e7).alias("value"), F.lit(5).alias("dq"))
    got = reproject.interpolated(exposure, rows, frame).collect()
    assert len(got) > 7_000
    for r in got:
        assert r.dq == (5 if r.foot > 0.01 else 0)
        y, x = 10.2571 + (r.ref_y - 20) / 0.625, 20.5137 + (r.ref_x - 30) / 0.625
        assert (r.map_y, r.map_x) == (y, x)
        seen = 3 + 7 * round((y - 3) / 7)  # the one pixel near enough
        assert r.foot == (1 - abs(y - seen)) * (1 - abs(x - 20))


def test_pixels_dealt_by_frame_are_summed_where_they_are(spark, case, tmp_path):
    exposures, pixels, _, _ = case
    pixels.write.parquet(f"{tmp_path}/pixels")
    dealt = reproject.by_frame(spark.read.parquet(f"{tmp_path}/pixels"), 50)
    for method in (reproject.interpolated, reproject.adaptive):
        got = method(exposures, dealt, REF, 30)
        # one exchange, that of the pixels; masks come with the sums
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        key = ["frame", "ref_y", "ref_x"]
        for a, b in zip(got.orderBy(*key).collect(), method(exposures, pixels, REF, 30).orderBy(*key).collect(), strict=True):
            assert (*a[:3], a.dq) == (*b[:3], b.dq) and (a.value, a.foot) == pytest.approx((b.value, b.foot), rel=1e-12)
