"""Queries of reprojection: every frame's pixels on a coarser reference frame, by each method.

Exposures share the reference frame's centre and directions, and have pixels 0.625 times as wide, so that their places are affine; each is shifted
by its own part of a pixel. Values come as whole units, of a hundred cents, feet as millionths, all after adding 0.31234, which ties don't survive.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Frame
from ..operators import reproject
from ..sources.views import OBS_SQL, WIDTH, obs, table
from . import query

#: of the reference frame: pixels of a detector's pixel, and its place of the exposures' centre
STEP, CENTRE_Y, CENTRE_X, NY, NX = 0.625, 20, 30, 1_000_000, 60
REFERENCE = Frame((30.0, 10.0), (CENTRE_X + 1.0, CENTRE_Y + 1.0), ((-0.016, 0.0), (0.0, 0.016)), NY, NX)
THRESHOLD, REACH = 0.01, reproject.KERNEL_REACH

_PLACED = f"""{OBS_SQL}, shift AS (SELECT s_suppkey AS frame, 10.0071e0 + (s_suppkey % 5) / 8e0 AS py, 20.0137e0 + (s_suppkey % 8) / 8e0 AS px FROM supplier),
pixel AS (SELECT frame, pix // {WIDTH} AS det_y, pix % {WIDTH} AS det_x, CAST(min(v) AS DOUBLE) AS v, CAST(bit_or(dq) AS BIGINT) AS dq FROM obs GROUP BY ALL),
placed AS (SELECT p.*, s.py, s.px, {CENTRE_Y} + (det_y - py) * {STEP}e0 AS ry, {CENTRE_X} + (det_x - px) * {STEP}e0 AS rx FROM pixel p JOIN shift s USING (frame)),
near AS (SELECT *, CAST(unnest(range(CAST(ceil(ry) AS BIGINT) - REACH, CAST(floor(ry) AS BIGINT) + REACH + 1)) AS BIGINT) AS ref_y FROM placed),
about AS (SELECT *, CAST(unnest(range(CAST(ceil(rx) AS BIGINT) - REACH, CAST(floor(rx) AS BIGINT) + REACH + 1)) AS BIGINT) AS ref_x FROM near),
seen AS (SELECT *, py + (ref_y - {CENTRE_Y}) / {STEP}e0 AS map_y, px + (ref_x - {CENTRE_X}) / {STEP}e0 AS map_x FROM about WHERE ref_y BETWEEN 0 AND {NY - 1} AND ref_x BETWEEN 0 AND {NX - 1}),
bilinear AS (SELECT *, (1 - abs(map_y - det_y)) * (1 - abs(map_x - det_x)) AS w FROM seen WHERE abs(map_y - det_y) < 1 AND abs(map_x - det_x) < 1),
heavy AS (SELECT frame, ref_y, ref_x, b FROM bilinear CROSS JOIN (SELECT unnest(range(8)) AS b) WHERE ((dq >> b) & 1) = 1 GROUP BY ALL HAVING sum(w) > {THRESHOLD}),
masks AS (SELECT frame, ref_y, ref_x, CAST(sum(1 << b) AS BIGINT) AS dq FROM heavy GROUP BY ALL)"""


def _sql(found: str, reach: int) -> str:
    return f"""WITH {_PLACED.replace("REACH", str(reach))}, found AS ({found})
SELECT frame, ref_y, ref_x, CAST(floor(value / 100 + 0.31234e0) AS BIGINT) AS units, CAST(floor(foot * 1000000 + 0.31234e0) AS BIGINT) AS foot, coalesce(dq, 0) AS dq,
  CAST(floor((py + (ref_y - {CENTRE_Y}) / {STEP}e0) * 1000 + 0.31234e0) AS BIGINT) AS map_y, CAST(floor((px + (ref_x - {CENTRE_X}) / {STEP}e0) * 1000 + 0.31234e0) AS BIGINT) AS map_x
FROM found JOIN shift USING (frame) LEFT JOIN masks USING (frame, ref_y, ref_x)"""


def _reprojected(spark, sf_dir, method: str):
    one = F.col("s_suppkey")
    exposures = table(spark, sf_dir, "supplier").select(
        one.alias("frame"), F.lit(30.0).alias("ra0"), F.lit(10.0).alias("dec0"), (20.0137 + one % 8 / 8).alias("px"), (10.0071 + one % 5 / 8).alias("py"),
        F.lit(-0.01).alias("cd11"), F.lit(0.0).alias("cd12"), F.lit(0.0).alias("cd21"), F.lit(0.01).alias("cd22"),
    )
    pixels = reproject.by_frame(obs(spark, sf_dir)).groupBy("frame", F.col("ref_y").alias("det_y"), F.col("ref_x").alias("det_x")).agg(
        F.min("v").cast("double").alias("value"), F.bit_or("dq").alias("dq")
    )
    found = reproject.METHODS[method](exposures, pixels, REFERENCE)

    def whole(scaled):
        return F.floor(scaled + 0.31234)

    return found.select(
        "frame", "ref_y", "ref_x", whole(F.col("value") / 100).alias("units"), whole(F.col("foot") * 1_000_000).alias("foot"), "dq",
        whole(F.col("map_y") * 1000).alias("map_y"), whole(F.col("map_x") * 1000).alias("map_x"),
    )


@query(_sql("SELECT frame, ref_y, ref_x, sum(w * v) AS value, sum(w) AS foot FROM bilinear GROUP BY ALL", 1))
def reproject_interp(spark, sf_dir):
    return _reprojected(spark, sf_dir, "interp")


@query(_sql(f"""SELECT frame, ref_y, ref_x, sum(a * v) / sum(a) AS value, sum(a) AS foot FROM (
  SELECT *, greatest(least(ry + {STEP / 2}e0, ref_y + 0.5e0) - greatest(ry - {STEP / 2}e0, ref_y - 0.5e0), 0) * greatest(least(rx + {STEP / 2}e0, ref_x + 0.5e0) - greatest(rx - {STEP / 2}e0, ref_x - 0.5e0), 0) AS a
  FROM seen) WHERE a > {reproject.SLIVER} GROUP BY ALL""", 1))  # fmt: skip
def reproject_exact(spark, sf_dir):
    return _reprojected(spark, sf_dir, "exact")


@query(_sql(f"""SELECT frame, ref_y, ref_x, sum(k * v) / sum(k) AS value,
  sum(k) * {STEP**2}e0 / (pi() * {reproject.KERNEL_WIDTH**2}e0 / 2 * (1 - exp(-2 * {REACH**2} / {reproject.KERNEL_WIDTH**2}e0))) AS foot
FROM (SELECT *, ((map_y - det_y) * (map_y - det_y) + (map_x - det_x) * (map_x - det_x)) * {STEP**2}e0 AS r2, exp(-2 * r2 / {reproject.KERNEL_WIDTH**2}e0) AS k FROM seen) WHERE r2 <= {REACH**2}
GROUP BY ALL HAVING foot >= 0.5""", 3))  # fmt: skip
def reproject_adaptive(spark, sf_dir):
    return _reprojected(spark, sf_dir, "adaptive")
