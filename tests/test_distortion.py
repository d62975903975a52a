"""Distorted frames: against numpy, there and back, from headers, and in pixels of another size."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.functions.distortion import Sip
from loomsky.functions.geometry import Frame, map_pixels
from loomsky.operators import reproject

SIP = Sip({(2, 0): 3e-6, (0, 2): -2e-6, (1, 1): 1e-6, (3, 0): 2e-10}, {(2, 0): -1e-6, (0, 2): 4e-6, (1, 2): -3e-10})
FRAME = Frame((266.0, -29.0), (1020.5, 1020.5), ((-0.0017, 0.0001), (0.0001, 0.0017)), 2040, 2040, SIP)


def test_round_trip_to_a_millionth_of_a_pixel(spark):
    at = spark.createDataFrame([(float(x), float(y)) for x in range(0, 2041, 255) for y in range(0, 2041, 255)], "x double, y double")
    x, y = FRAME.pixel(*FRAME.sky(F.col("x"), F.col("y")))
    rows = at.select("x", "y", x.alias("bx"), y.alias("by"), (FRAME.sky(F.col("x"), F.col("y"))[0]).alias("ra"), replace(FRAME, sip=None).sky(F.col("x"), F.col("y"))[0].alias("plain")).collect()
    assert max(max(abs(r.x - r.bx), abs(r.y - r.by)) for r in rows) < 1e-6
    assert max(abs(r.ra - r.plain) for r in rows) > 1e-3  # pixels are moved by several of their width


def test_polynomials_and_slopes_are_numpys(spark):
    u, v = (np.random.default_rng(s).normal(0, 300, 40) for s in (1, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, v)], "u double, v double")
    forms = [*SIP.undistorted(F.col("u"), F.col("v")), *SIP.slopes(F.col("u"), F.col("v"))]
    got = np.array([tuple(r) for r in df.select(*forms).collect()])

    def at(u, v):
        return u + sum(c * u**p * v**q for (p, q), c in SIP.a.items()), v + sum(c * u**p * v**q for (p, q), c in SIP.b.items())

    h = 1e-4
    slopes = [(at(u + h, v)[i] - at(u - h, v)[i]) / (2 * h) if k == 0 else (at(u, v + h)[i] - at(u, v - h)[i]) / (2 * h) for i in (0, 1) for k in (0, 1)]
    assert np.allclose(got[:, :2].T, at(u, v)) and np.allclose(got[:, 2:].T, slopes, atol=1e-6)


def test_header_sizes_and_nothing(spark):
    header = {"A_ORDER": "2", "A_2_0": "3e-6", "A_3_0": "9.0", "B_ORDER": "2", "B_0_2": "4e-6", "B_1_1": None}
    assert Sip.of(header) == Sip({(2, 0): 3e-6}, {(0, 2): 4e-6}) and Sip.of({"CRPIX1": "1"}) is None
    fine = FRAME.upscaled(2)
    df = spark.createDataFrame([(100.0, 1700.0), (None, 3.0)], "x double, y double")
    coarse = FRAME.sky(F.col("x"), F.col("y"))
    # crpix is scaled without a half-pixel shift, so places about it are doubled
    x, y = fine.pixel(*coarse)
    got, none = df.select(x.alias("x"), y.alias("y")).collect()
    assert got.x == pytest.approx(2 * (100.0 + 1) - 1, abs=1e-6) and got.y == pytest.approx(2 * (1700.0 + 1) - 1, abs=1e-6) and none.x is None
    straight = map_pixels(F.col("x"), F.col("y"), replace(FRAME, sip=Sip()), replace(FRAME, sip=None))
    assert df.limit(1).select(straight[0].alias("x")).first().x == pytest.approx(100.0, abs=1e-7)


def test_detector_to_reference_and_back(spark):
    row = (100.0, 1800.0, 266.0, -29.0, 1019.5, 1019.5, -0.0017, 0.0, 0.0, 0.0017)
    df = spark.createDataFrame([row], "det_x double, det_y double, ra0 double, dec0 double, px double, py double, cd11 double, cd12 double, cd21 double, cd22 double")
    reference = Frame((266.1, -29.1), (900.0, 900.0), ((-0.002, 0.0), (0.0, 0.002)), 1800, 1800)
    there = reproject.to_reference(df, reference, sip=SIP)
    r = reproject.to_detector(there, reference, y="ref_fy", x="ref_fx", sip=SIP).first()
    assert abs(r.map_x - 100.0) < 1e-6 and abs(r.map_y - 1800.0) < 1e-6
    plain = reproject.to_reference(df, reference).first()
    u, v = 100.0 - 1019.5, 1800.0 - 1019.5
    moved = sum(c * u**p * v**q for (p, q), c in SIP.a.items()) * 0.0017 / 0.002
    assert there.first().ref_fx - plain.ref_fx == pytest.approx(moved, abs=0.01)
