"""Co-addition against plain Python."""

import math

import numpy as np
import pytest

from loomsky.operators import coadd


@pytest.fixture(scope="module")
def obs(spark):
    r = np.random.default_rng(1)
    rows = [(int(f), int(p // 5), int(p % 5), float(r.normal(10, 3)), float(r.integers(0, 4)), float(r.normal())) for f in range(12) for p in range(20)]
    return spark.createDataFrame(rows, "frame int, ref_y int, ref_x int, value double, weight double, a double"), rows


def by_pixel(rows):
    out = {}
    for _, y, x, v, w, a in rows:
        out.setdefault((y, x), []).append((v, w, a))
    return {k: np.array(v) for k, v in out.items()}


def test_mean_std_and_clip(obs):
    df, rows = obs
    expected = by_pixel(rows)
    means = {(r.ref_y, r.ref_x): r for r in coadd.coadd_mean(df, aux=("a",)).collect()}
    stds = {(r.ref_y, r.ref_x): r for r in coadd.coadd_std(df, aux=("a",)).collect()}
    clipped = {(r.ref_y, r.ref_x): r for r in coadd.coadd_sigma_clip(df, 1.0).collect()}
    for k, p in expected.items():
        v, w, a = p.T
        m = (w * v).sum() / w.sum()
        s = math.sqrt((w * (v - m) ** 2).sum() / w.sum())
        ma = (w * a).sum() / w.sum()
        assert means[k].data == pytest.approx(m) and means[k].a == pytest.approx(ma) and means[k].weight == w.sum()
        assert stds[k].data == pytest.approx(s) and stds[k].a == pytest.approx(math.sqrt((w * (a - ma) ** 2).sum() / w.sum()))
        keep = w * (abs(v - m) <= s)
        assert clipped[k].data == pytest.approx((keep * v).sum() / keep.sum() if keep.sum() else 0.0)


def test_wide_clip_is_the_mean(obs):
    df, _ = obs
    means = {(r.ref_y, r.ref_x): r.data for r in coadd.coadd_mean(df).collect()}
    assert all(means[r.ref_y, r.ref_x] == pytest.approx(r.data) for r in coadd.coadd_sigma_clip(df, 1e9).collect())


def test_no_weight_gives_zero(spark):
    df = spark.createDataFrame([(0, 0, 5.0, 0.0)], "ref_y int, ref_x int, value double, weight double")
    for f in (coadd.coadd_mean, coadd.coadd_std, lambda d: coadd.coadd_sigma_clip(d, 2)):
        assert [(r.data, r.weight) for r in f(df).collect()] == [(0.0, 0.0)]
    assert coadd.coadd_mean(df.limit(0)).collect() == []


def test_modes_are_checked(obs):
    df, _ = obs
    with pytest.raises(ValueError):
        coadd.coadd(df, "median")
    with pytest.raises(ValueError):
        coadd.coadd(df, "sigma_clip")
    assert coadd.coadd(df, "cache").where("weight = 0").isEmpty()


def test_wavelength_moments_of_one_band(spark):
    df = spark.createDataFrame([(0, 0, 2.0, 1.5, 0.3), (0, 0, 0.0, 9.0, 9.0)], "ref_y int, ref_x int, weight double, bc double, bw double")
    r = coadd.wavelength_moments(df).first()
    assert r.wav_mean == pytest.approx(1.5) and r.wav_std == pytest.approx(0.3 / math.sqrt(12))


def test_one_exchange_for_a_clip(obs):
    df, _ = obs
    plan = coadd.coadd_sigma_clip(df, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
