"""Tiles with a halo: against looking cells up one by one, and what their plans shuffle."""

import math
import random

import pytest

from loomsky.operators import prepare, tiles
from loomsky.queries import QUERIES

from .conftest import SF


def four(y, x):
    y0, x0 = math.floor(y), math.floor(x)
    return [((y0 + a, x0 + b), (y - y0 if a else 1 - y + y0) * (x - x0 if b else 1 - x + x0)) for a in (0, 1) for b in (0, 1)]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    cells = {(y, x): rng.random() * 100 for y in range(-3, 71) for x in range(0, 40) if rng.random() < 0.9}
    places = [(rng.uniform(-6, 74), rng.uniform(-4, 44)) for _ in range(1500)]
    places += [(float(y), float(x)) for y in (-3, 0, 31, 32, 33, 63, 64, 70) for x in (0, 31, 32, 39)] + [(31.5, 31.25), (1e6, -1e6), (math.nan, 2.0), (2.0, math.nan), (None, 1.0)]
    targets = spark.createDataFrame([(i, *p, 7) for i, p in enumerate(places)], "id int, map_y double, map_x double, chunk int")
    return cells, places, targets


def known(p):
    return p[0] is not None and not math.isnan(p[0]) and not math.isnan(p[1])


@pytest.mark.parametrize("size", [4, 32])
def test_interpolation(spark, case, size, monkeypatch):
    cells, places, targets = case
    raster = spark.createDataFrame([(*k, v) for k, v in cells.items()], "det_y long, det_x long, raster double")
    monkeypatch.setattr(tiles, "SIZE", size)
    for small in (1 << 24, 0):  # broadcast, and not
        monkeypatch.setattr(tiles, "SMALL", small)
        got = {r.id: r.raster for r in tiles.interpolated(targets, raster).collect()}
        want = {i: sum(w * cells.get(c, 0.0) for c, w in four(*p)) if known(p) else 0.0 for i, p in enumerate(places)}
        assert got == pytest.approx(want)


def test_a_cell_of_no_weight_does_not_count(spark):
    raster = spark.createDataFrame([(0, 0, 5.0), (0, 1, math.nan), (1, 0, math.nan)], "det_y long, det_x long, raster double")
    targets = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.5)], "id int, map_y double, map_x double")
    got = {r.id: r.raster for r in tiles.interpolated(targets, raster).collect()}
    assert got[0] == 5.0 and math.isnan(got[1])
    assert tiles.interpolated(targets, raster.limit(0)).where("raster <> 0").isEmpty()


def test_rasters_of_frames(spark):
    rows = [(f, y, x, float(100 * f + 10 * y + x)) for f in (1, 2) for y in range(5) for x in range(5)]
    rasters = spark.createDataFrame(rows, "frame int, det_y int, det_x int, raster double")
    targets = spark.createDataFrame([(1, 1.5, 2.0), (2, 3.0, 3.5), (3, 1.0, 1.0)], "frame int, map_y double, map_x double")
    got = {r.frame: r.at for r in tiles.interpolated(targets, rasters, name="at", by=["frame"]).collect()}
    assert got == {1: 117.0, 2: 233.5, 3: 0.0}


def test_shares_and_masks(spark, case):
    cells, places, targets = case
    ids = {k: int(v) % 5 - 1 for k, v in cells.items()}
    words = {k: [0, 1, 1 << 31, 0xFFFFFFFF, 6][int(v) % 5] for k, v in cells.items()}
    chunk_map = spark.createDataFrame([(*k, v) for k, v in ids.items()], "det_y long, det_x long, chunk long")
    flags = spark.createDataFrame([(*k, v) for k, v in words.items()], "det_y long, det_x long, dq long")
    shares, masks = {}, {}
    for i, p in enumerate(places):
        masks[i] = 0
        if known(p):
            for c, w in four(*p):
                if w > 0 and ids.get(c, -1) >= 0:
                    shares[i, ids[c]] = shares.get((i, ids[c]), 0.0) + w
            masks[i] = sum(1 << b for b in range(32) if sum(w for c, w in four(*p) if words.get(c, 0) >> b & 1) > 0.2)
    assert {(r.id, r.chunk): r.share for r in tiles.shares(targets, chunk_map).collect()} == pytest.approx(shares)
    assert {r.id: r.dq for r in tiles.mask(targets, flags, threshold=0.2).collect()} == masks


def above(df, scan):
    """The operators over the line of the plan that has ``scan``."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    at = next(i for i, x in enumerate(lines) if scan in x)
    out, level = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < level:
            out.append(lines[i])
            level = depth[i]
    return out


@pytest.mark.parametrize("name", ["bilinear_resample", "chunk_contrib", "interp_dq"])
def test_targets_are_not_shuffled(spark, name):
    over = above(QUERIES[name](spark, SF), "lineitem.parquet")
    assert any("BroadcastHashJoin" in x for x in over) and not any("Exchange" in x for x in over)


def test_preparation_joins_tiles_once(spark):
    obs = spark.createDataFrame([(0, 0, 0, 5.0, 0.5, 0.5)], "frame int, ref_y int, ref_x int, value double, map_y double, map_x double")
    cells = [(y, x, 2.0) for y in (0, 1) for x in (0, 1)]
    weights = spark.createDataFrame(cells, "det_y long, det_x long, weight double")
    surface = spark.createDataFrame([(0, *c) for c in cells], "frame int, det_y long, det_x long, raster double")
    done = prepare.prepare(obs, grid_weight=weights, offset_surface=surface)
    assert [(r.value, r.weight) for r in done.collect()] == [(3.0, 2.0)]
    assert sorted(done.columns) == sorted([*obs.columns, "weight"])
    over = above(prepare.prepare(obs, grid_weight=weights), "Scan ExistingRDD")
    assert any("BroadcastHashJoin" in x for x in over) and not any("Exchange" in x for x in over)
