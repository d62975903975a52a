"""Queries of splines, spectra, geometry, sources and the whole job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..functions.distortion import Sip
from ..operators import chunks, coadd, spectral, splines
from ..sources import readers, sinks
from ..sources.views import GRID_SQL, OBS_SQL, grid, obs, table
from ..streaming import coadd as stream
from . import query


def rounded(c, digits: int = 6):
    """Rounding that both engines do alike."""
    return F.floor(c * float(10**digits) + 0.5).cast("double") / float(10**digits)


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"CAST(floor(({x}) * {float(10**digits)!r}::DOUBLE + 0.5e0) AS DOUBLE) / {float(10**digits)!r}::DOUBLE"


_KNOTS = f"""{GRID_SQL}, k AS (SELECT det_y, CAST(det_x AS DOUBLE) AS x, CAST(raster AS DOUBLE) AS y FROM grid WHERE chunk % 3 = 0),
t AS (SELECT det_y, CAST(det_x AS DOUBLE) + 0.25e0 AS x FROM grid)"""


@query(f"""WITH {_KNOTS}, j AS (
SELECT t.det_y, t.x, (SELECT max(k.x) FROM k WHERE k.det_y = t.det_y AND k.x <= t.x) AS x0, (SELECT min(k.x) FROM k WHERE k.det_y = t.det_y AND k.x >= t.x) AS x1 FROM t)
SELECT j.det_y, j.x, coalesce(l.y + (r.y - l.y) * (j.x - l.x) / (r.x - l.x), l.y, r.y) AS y FROM j LEFT JOIN k l ON l.det_y = j.det_y AND l.x = x0 LEFT JOIN k r ON r.det_y = j.det_y AND r.x = x1""")
def spline_linear(spark, sf_dir):
    g = grid(spark, sf_dir)
    knots = g.where("chunk % 3 = 0").select("det_y", F.col("det_x").cast("double").alias("x"), F.col("raster").cast("double").alias("y"))
    return splines.linear(knots, g.select("det_y", (F.col("det_x").cast("double") + 0.25).alias("x")), ["det_y"])


_BINS = f"""{GRID_SQL}, b AS (SELECT det_y, det_x, CAST(det_x AS DOUBLE) AS low, CAST(det_x + 1 AS DOUBLE) AS high, CAST(chunk - 25 AS DOUBLE) AS m FROM grid),
n AS (SELECT *, lag(m) OVER w AS m1, lag(m, 2) OVER w AS m2, lead(m) OVER w AS p1, lead(m, 2) OVER w AS p2 FROM b WINDOW w AS (PARTITION BY det_y ORDER BY low))"""


def _bins(spark, sf_dir):
    x = F.col("det_x")
    return grid(spark, sf_dir).select(
        "det_y", "det_x", x.cast("double").alias("low"), (x + 1).cast("double").alias("high"), (F.col("chunk") - 25).cast("double").alias("mean")
    )


def _harmonic(a: str, c: str) -> str:
    return f"CASE WHEN {a} * {c} > 0 THEN 6e0 / (3e0 / {a} + 3e0 / {c}) ELSE 0e0 END"


def _end(a: str, c: str) -> str:
    d = f"((3e0 * {a} - {c}) / 2e0)"
    return f"CASE WHEN {d} * {a} <= 0 THEN 0e0 WHEN {a} * {c} <= 0 AND abs({d}) > 3e0 * abs({a}) THEN 3e0 * {a} ELSE {d} END"


@query(f"""WITH {_BINS}, d AS (SELECT det_y, det_x, m, CASE WHEN m1 IS NULL THEN {_end("m", "p1")} ELSE {_harmonic("m1", "m")} END AS d0,
CASE WHEN p1 IS NULL THEN {_end("m", "m1")} ELSE {_harmonic("m", "p1")} END AS d1 FROM n)
SELECT det_y, det_x, {rounded_sql("1.5e0 * m - 0.25e0 * d0 - 0.25e0 * d1")} AS y FROM d""")
def spline_pchip(spark, sf_dir):
    slopes = splines.edge_slopes(_bins(spark, sf_dir), ["det_y"], "pchip")
    middle = splines.mean_preserving((F.col("low") + F.col("high")) / 2)
    return slopes.select("det_y", "det_x", rounded(middle).alias("y"))


def _akima(a: str, b: str, c: str, d: str) -> str:
    return f"CASE WHEN abs({d} - {c}) + abs({b} - {a}) > 0 THEN (abs({d} - {c}) * {b} + abs({b} - {a}) * {c}) / (abs({d} - {c}) + abs({b} - {a})) ELSE ({b} + {c}) / 2e0 END"


@query(f"""WITH {_BINS}, e AS (SELECT det_y, det_x, m, coalesce(p1, 2 * m - m1) AS p1, coalesce(m1, 2 * m - p1) AS m1, m2, p2 FROM n),
f AS (SELECT det_y, det_x, m, p1, m1, coalesce(m2, 2 * m1 - m) AS m2, coalesce(p2, 2 * p1 - m) AS p2 FROM e),
d AS (SELECT det_y, det_x, m, {_akima("m2", "m1", "m", "p1")} AS d0, {_akima("m1", "m", "p1", "p2")} AS d1 FROM f)
SELECT det_y, det_x, {rounded_sql("1.5e0 * m - 0.25e0 * d0 - 0.25e0 * d1")} AS y FROM d""")
def spline_akima(spark, sf_dir):
    slopes = splines.edge_slopes(_bins(spark, sf_dir), ["det_y"], "akima")
    middle = splines.mean_preserving((F.col("low") + F.col("high")) / 2)
    return slopes.select("det_y", "det_x", rounded(middle).alias("y"))


@query(f"""WITH RECURSIVE {_BINS}, lines AS (SELECT *, count(*) OVER (PARTITION BY det_y) AS n FROM b),
r AS (SELECT b.det_y, b.det_x AS i, b.m, CASE WHEN b.det_x = 0 THEN 0e0 ELSE 1e0 END AS a, CASE WHEN b.det_x = 0 THEN 1e0 ELSE 4e0 END AS d, CASE WHEN b.det_x = 0 THEN 2e0 ELSE 1e0 END AS c,
  CASE WHEN b.det_x = 0 THEN (5e0 * b.m + p.m) / 2e0 ELSE 3e0 * (q.m + b.m) END AS r, b.n FROM lines b LEFT JOIN b p ON p.det_y = b.det_y AND p.det_x = 1 LEFT JOIN b q ON q.det_y = b.det_y AND q.det_x = b.det_x - 1
  UNION ALL SELECT b.det_y, b.n, NULL, 2e0, 1e0, 0e0, (q.m + 5e0 * b.m) / 2e0, b.n FROM lines b JOIN b q ON q.det_y = b.det_y AND q.det_x = b.n - 2 WHERE b.det_x = b.n - 1),
f AS (SELECT det_y, i, c / d AS c, r / d AS r FROM r WHERE i = 0 UNION ALL
  SELECT r.det_y, r.i, r.c / (r.d - r.a * f.c), (r.r - r.a * f.r) / (r.d - r.a * f.c) FROM f JOIN r ON r.det_y = f.det_y AND r.i = f.i + 1),
g AS (SELECT det_y, i, r AS s FROM f WHERE c = 0 UNION ALL SELECT f.det_y, f.i, f.r - f.c * g.s FROM g JOIN f ON f.det_y = g.det_y AND f.i = g.i - 1)
SELECT b.det_y, b.det_x, {rounded_sql("1.5e0 * b.m - 0.25e0 * k.s - 0.25e0 * l.s")} AS y FROM b JOIN g k ON k.det_y = b.det_y AND k.i = b.det_x JOIN g l ON l.det_y = b.det_y AND l.i = b.det_x + 1""")
def spline_cubic(spark, sf_dir):
    """The not-a-knot cubic through the running integral of each raster line, at the middles."""
    slopes = splines.edge_slopes(_bins(spark, sf_dir), ["det_y"], "cubic")
    return slopes.select("det_y", "det_x", rounded(splines.mean_preserving((F.col("low") + F.col("high")) / 2)).alias("y"))


def _offsets(spark, sf_dir):
    """A grid of mean values for each frame: chunks by quarters of the raster line; empty ones are 0."""
    o = obs(spark, sf_dir).where("w > 20")
    seen = o.groupBy("frame", F.col("chunk").alias("sub"), F.expr("ref_x div 10").alias("col")).agg(F.floor(F.sum("v") / F.count("*")).cast("double").alias("value"))
    frames = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"))
    cells = frames.select("frame", F.explode(F.expr("sequence(0L, 6L)")).alias("sub")).select("frame", "sub", F.explode(F.expr("sequence(0L, 4L)")).alias("col"))
    return cells.join(seen, ["frame", "sub", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


@query()
def offset_surface(spark, sf_dir):
    """Each frame's offsets as a surface that keeps their means; the tests compare with the means."""
    return splines.surface(_offsets(spark, sf_dir), factor=2, fill=True)


@query()
def fill_linear(spark, sf_dir):
    """Missing offsets filled inside triangles of known ones; the tests compare with planes."""
    return splines.fill_linear(_offsets(spark, sf_dir))


_OFFSETS = f"""{OBS_SQL}, seen AS (SELECT frame, chunk AS sub, ref_x // 10 AS col, floor(CAST(sum(v) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS value FROM obs WHERE w > 20 GROUP BY ALL),
cells AS (SELECT s_suppkey AS frame, a AS sub, b AS col FROM supplier CROSS JOIN (SELECT unnest(range(7)) AS a) CROSS JOIN (SELECT unnest(range(5)) AS b)),
off AS (SELECT frame, sub, col, coalesce(value, 0e0) AS value FROM cells LEFT JOIN seen USING (frame, sub, col))"""


@query(f"""WITH {_OFFSETS}, near AS (SELECT o.frame, o.sub, o.col, p.value, row_number() OVER (PARTITION BY o.frame, o.sub, o.col ORDER BY (o.sub - p.sub) * (o.sub - p.sub) + (o.col - p.col) * (o.col - p.col), p.sub, p.col) AS k
FROM off o JOIN off p ON o.frame = p.frame AND o.value = 0 AND p.value <> 0)
SELECT o.frame, o.sub, o.col, coalesce(n.value, o.value) AS value FROM off o LEFT JOIN near n ON n.frame = o.frame AND n.sub = o.sub AND n.col = o.col AND n.k = 1""")
def fill_nearest(spark, sf_dir):
    return splines.fill_nearest(_offsets(spark, sf_dir))


@query(f"""WITH {GRID_SQL}, e AS (SELECT unnest([95000, 120000, 140000]) AS edge), r AS (SELECT edge, det_x, det_y, row_number() OVER (PARTITION BY edge, det_x ORDER BY abs(raster - edge), det_y) AS k FROM grid CROSS JOIN e)
SELECT CAST(edge AS BIGINT) AS edge, det_x, det_y FROM r WHERE k = 1""")
def edge_argmin(spark, sf_dir):
    edges = spark.createDataFrame([(95000,), (120000,), (140000,)], "edge long")
    return spectral.edge_rows(grid(spark, sf_dir), edges, wave="raster")


@query(f"""WITH {GRID_SQL}, e AS (SELECT unnest([95000, 120000, 140000]) AS edge), r AS (SELECT edge, det_x, det_y, row_number() OVER (PARTITION BY edge, det_x ORDER BY abs(raster - edge), det_y) AS k FROM grid CROSS JOIN e)
SELECT CAST(edge AS BIGINT) AS edge, det_x, det_y FROM r WHERE k = 1 AND NOT (edge = 140000 AND det_x > 12 AND det_x < 38)""")
def edge_samples(spark, sf_dir):
    edges = spark.createDataFrame([(95000,), (120000,), (140000,)], "edge long")
    return spectral.edge_samples(grid(spark, sf_dir), edges, size=50, margin=12, wave="raster")


@query(f"""WITH {GRID_SQL}, p AS (SELECT chunk % 5 AS edge, det_x AS x, (det_y % 20) AS y FROM grid),
s AS (SELECT edge, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * x + y * y) AS DOUBLE) AS sz, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(x * y) AS DOUBLE) AS sxy,
CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(x * (x * x + y * y)) AS DOUBLE) AS sxz, CAST(sum(y * (x * x + y * y)) AS DOUBLE) AS syz FROM p GROUP BY edge),
c AS (SELECT *, sxx - sx * sx / n AS cxx, sxy - sx * sy / n AS cxy, syy - sy * sy / n AS cyy, sxz - sx * sz / n AS cxz, syz - sy * sz / n AS cyz FROM s),
d AS (SELECT *, (cxz * cyy - cyz * cxy) / (2 * (cxx * cyy - cxy * cxy)) AS xc, (cyz * cxx - cxz * cxy) / (2 * (cxx * cyy - cxy * cxy)) AS yc FROM c)
SELECT edge, {rounded_sql("xc", 4)} AS xc, {rounded_sql("yc", 4)} AS yc, {rounded_sql("sqrt(greatest((sz - 2 * xc * sx - 2 * yc * sy) / n + xc * xc + yc * yc, 0e0))", 4)} AS radius FROM d""")
def arc_fit(spark, sf_dir):
    points = grid(spark, sf_dir).select((F.col("chunk") % 5).alias("edge"), F.col("det_x").alias("x"), (F.col("det_y") % 20).alias("y"))
    found = spectral.kasa(spectral.circle_sums(points, by=["edge"]))
    return found.select("edge", *[rounded(F.col(c), 4).alias(c) for c in ("xc", "yc", "radius")])


def _circle_sql(n: int) -> str:
    """A step of Gauss and Newton's method from the centres c{n - 1}."""
    return f"""
d{n} AS (SELECT edge, sqrt((xc - x) * (xc - x) + (yc - y) * (yc - y)) AS d, (xc - x) / d AS u, (yc - y) / d AS v FROM p JOIN c{n - 1} USING (edge)),
q{n} AS (SELECT edge, covar_pop(u, u) AS a, covar_pop(u, v) AS b, covar_pop(v, v) AS c, covar_pop(u, d) AS gu, covar_pop(v, d) AS gv FROM d{n} GROUP BY edge),
c{n} AS MATERIALIZED (SELECT edge, xc + (b * gv - c * gu) / (a * c - b * b) AS xc, yc + (b * gu - a * gv) / (a * c - b * b) AS yc FROM c{n - 1} JOIN q{n} USING (edge))"""


#: steps of the SQL, many more than are needed
_CIRCLE_STEPS = 25


@query(f"""WITH {GRID_SQL}, p AS MATERIALIZED (SELECT chunk % 5 AS edge, CAST(det_x AS DOUBLE) AS x, 80e0 - sqrt((60e0 + 5e0 * CAST(chunk % 5 AS DOUBLE)) * (60e0 + 5e0 * CAST(chunk % 5 AS DOUBLE)) - (det_x - 25e0) * (det_x - 25e0)) + CAST(raster % 101 - 50 AS DOUBLE) / 100e0 AS y FROM grid),
c0 AS MATERIALIZED (SELECT DISTINCT edge, 25e0 AS xc, 80e0 AS yc FROM p),{",".join(_circle_sql(n) for n in range(1, _CIRCLE_STEPS + 1))}
SELECT edge, {rounded_sql("any_value(xc)", 4)} AS xc, {rounded_sql("any_value(yc)", 4)} AS yc, {rounded_sql("avg(sqrt((xc - x) * (xc - x) + (yc - y) * (yc - y)))", 4)} AS radius, true AS converged
FROM p JOIN c{_CIRCLE_STEPS} USING (edge) GROUP BY edge""")
def arc_fit_geometric(spark, sf_dir):
    """A circle for each edge with the least squares of distances, to rows planted on arcs of the raster and moved by up to half a cell."""
    edge = F.col("chunk") % 5
    radius = 60.0 + 5.0 * edge.cast("double")
    y = 80.0 - F.sqrt(radius * radius - (F.col("det_x") - 25.0) * (F.col("det_x") - 25.0)) + (F.col("raster") % 101 - 50).cast("double") / 100.0
    points = grid(spark, sf_dir).select(edge.alias("edge"), F.col("det_x").cast("double").alias("x"), y.alias("y"))
    found = spectral.fit_circles(points, by=["edge"])
    return found.select("edge", *[rounded(F.col(c), 4).alias(c) for c in ("xc", "yc", "radius")], "converged")


@query()
def arc_fit_joint(spark, sf_dir):
    """One centre and a radius for each edge, fitted to rows planted on arcs of the raster; the tests compare with them."""
    g = grid(spark, sf_dir).select((F.col("chunk") % 5).cast("int").alias("edge"), F.col("det_x").alias("x"))
    points = g.withColumn("y", 900 - F.sqrt((700.0 + 30 * F.col("edge")) ** 2 - (F.col("x") - 25.0) ** 2))
    (xc, yc), radii = spectral.fit_arcs(points, (20.0, 850.0))
    return spark.createDataFrame([(int(e), xc, yc, r) for e, r in sorted(radii.items())], "edge int, xc double, yc double, radius double")


RADII = [float(150 + 8 * i) for i in range(8)]


@query(f"""WITH {GRID_SQL}, {OBS_SQL}, c AS (SELECT cell, sqrt(CAST((det_x - 25) * (det_x - 25) + (det_y - 200) * (det_y - 200) AS DOUBLE)) AS r, CAST(len(list_filter({RADII!r}, lambda q: q < r)) AS BIGINT) AS chunk FROM grid),
v AS (SELECT frame, chunk, floor(CAST(sum(v) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS m FROM obs WHERE chunk BETWEEN 1 AND {len(RADII) - 1} GROUP BY ALL),
n AS (SELECT *, lag(m) OVER w AS m1, lead(m) OVER w AS p1 FROM v WINDOW w AS (PARTITION BY frame ORDER BY chunk)),
d AS (SELECT frame, chunk, m, CASE WHEN m1 IS NULL AND p1 IS NULL THEN m WHEN m1 IS NULL THEN {_end("m", "p1")} ELSE {_harmonic("m1", "m")} END AS d0,
  CASE WHEN p1 IS NULL AND m1 IS NULL THEN m WHEN p1 IS NULL THEN {_end("m", "m1")} ELSE {_harmonic("m", "p1")} END AS d1 FROM n),
s AS (SELECT frame, cell, m, d0, d1, (r - (142e0 + 8e0 * CAST(chunk AS DOUBLE))) / 8e0 AS s FROM c JOIN d USING (chunk))
SELECT frame, cell, CAST(round(m * (6 * s - 6 * s * s) + d0 * (1 - 4 * s + 3 * s * s) + d1 * (3 * s * s - 2 * s)) AS BIGINT) AS cents FROM s""")
def radial_offsets(spark, sf_dir):
    """Frames' mean values by arc, smooth in the distance to the arcs' centre, at each raster cell, to the cent."""
    cells = chunks.arc_chunks(grid(spark, sf_dir).drop("chunk"), 25, 200, RADII)
    cells = cells.withColumn("r", F.sqrt((F.col("det_x") - 25.0) ** 2 + (F.col("det_y") - 200.0) ** 2)).select("cell", "chunk", "r")
    means = obs(spark, sf_dir).where("chunk > 0").groupBy("frame", "chunk").agg(F.floor(F.sum("v") / F.count("*")).cast("double").alias("value"))
    return splines.radial(means, RADII, cells, kind="pchip").select("frame", "cell", F.round("value").cast("bigint").alias("cents"))


def _inner_sql(a: str, c: str, ha: str, hc: str) -> str:
    w1, w2 = f"(2e0 * {hc} + {ha})", f"({hc} + 2e0 * {ha})"
    return f"CASE WHEN {a} * {c} > 0 THEN ({w1} + {w2}) / ({w1} / {a} + {w2} / {c}) ELSE 0e0 END"


def _end_sql(a: str, c: str, ha: str, hc: str) -> str:
    d = f"(((2e0 * {ha} + {hc}) * {a} - {ha} * {c}) / ({ha} + {hc}))"
    return f"CASE WHEN {c} IS NULL THEN {a} WHEN {d} * {a} <= 0 THEN 0e0 WHEN {a} * {c} <= 0 AND abs({d}) > 3e0 * abs({a}) THEN 3e0 * {a} ELSE {d} END"


@query(f"""WITH {GRID_SQL}, g AS (SELECT det_y, det_x, chunk // 25 AS level, CAST(row_number() OVER w - 1 AS BIGINT) AS place, lag(chunk // 25) OVER w AS before FROM grid WINDOW w AS (PARTITION BY det_y ORDER BY det_x)),
h AS (SELECT det_y, CAST(level AS DOUBLE) AS m, CAST(place AS DOUBLE) AS low, CAST(lead(place) OVER w AS DOUBLE) AS high, row_number() OVER w AS n FROM g WHERE place = 0 OR before <> level WINDOW w AS (PARTITION BY det_y ORDER BY place)),
r AS (SELECT *, high - low AS h, lag(m) OVER w AS m1, lead(m) OVER w AS p1, lag(high - low) OVER w AS h1, lead(high - low) OVER w AS hp FROM h WHERE high IS NOT NULL AND n > 1 WINDOW w AS (PARTITION BY det_y ORDER BY low)),
d AS (SELECT det_y, m, low, high, CASE WHEN m1 IS NULL THEN {_end_sql("m", "p1", "h", "hp")} ELSE {_inner_sql("m1", "m", "h1", "h")} END AS d0,
  CASE WHEN p1 IS NULL THEN {_end_sql("m", "m1", "h", "h1")} ELSE {_inner_sql("m", "p1", "h", "hp")} END AS d1 FROM r),
s AS (SELECT g.det_y, g.det_x, g.level, m, d0, d1, (place + 0.5e0 - low) / (high - low) AS s FROM g LEFT JOIN d ON g.det_y = d.det_y AND place + 0.5e0 > low AND place + 0.5e0 < high)
SELECT det_y, det_x, level, {rounded_sql("m * (6 * s - 6 * s * s) + d0 * (1 - 4 * s + 3 * s * s) + d1 * (3 * s * s - 2 * s)")} AS smooth FROM s""")
def smoothed_runs(spark, sf_dir):
    """Raster lines of coarse values, smoothed between runs."""
    lines = grid(spark, sf_dir).select("det_y", "det_x", F.expr("chunk div 25").alias("level"))
    return splines.by_runs(lines, ["det_y"], "det_x", "level").withColumn("smooth", rounded(F.col("smooth")))


@query("""WITH t AS (SELECT l_suppkey % 6 AS k, CAST(sum(l_quantity) AS DOUBLE) AS s FROM lineitem GROUP BY 1), w AS (SELECT CAST(power(2, k) AS BIGINT) AS workers, s AS seconds FROM t)
SELECT workers, (SELECT seconds FROM w WHERE workers = 1) / seconds AS speedup, (SELECT seconds FROM w WHERE workers = 1) / seconds / workers AS efficiency FROM w""")
def scaling(spark, sf_dir):
    """Speed-up and efficiency by workers, of sums that stand for seconds."""
    k = F.col("l_suppkey") % 6
    times = table(spark, sf_dir, "lineitem").groupBy(F.pow(F.lit(2.0), k).cast("bigint").alias("workers")).agg(F.sum("l_quantity").alias("seconds"))
    one = times.where("workers = 1").select(F.col("seconds").alias("_one"))  # one row
    speedup = F.col("_one") / F.col("seconds")
    return times.join(F.broadcast(one)).select("workers", speedup.alias("speedup"), (speedup / F.col("workers")).alias("efficiency"))


@query(f"""WITH p AS (SELECT c_custkey AS id, CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey % 40 AS DOUBLE) AS y FROM customer)
SELECT id, {rounded_sql("20e0 + (x - 10e0) * 2e0", 4)} AS x, {rounded_sql("30e0 + (y - 5e0) * 2e0", 4)} AS y FROM p""")
def map_pixels(spark, sf_dir):
    """Pixels of a frame in one of half its pixel size about the same place."""
    source = geometry.Frame((120.0, 10.0), (11.0, 6.0), ((-0.01, 0.0), (0.0, 0.01)), 40, 50)
    target = geometry.Frame((120.0, 10.0), (21.0, 31.0), ((-0.005, 0.0), (0.0, 0.005)), 80, 100)
    cells = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).cast("double").alias("x"), (F.col("c_custkey") % 40).cast("double").alias("y")
    )
    x, y = geometry.map_pixels(F.col("x"), F.col("y"), source, target)
    return cells.select("id", rounded(x, 4).alias("x"), rounded(y, 4).alias("y"))


#: of the distorted detector: up to some percent at its corners, which are 30 pixels from the reference pixel
SIP = Sip({(2, 0): 6e-4, (1, 1): -4e-4, (0, 2): 3e-4, (3, 0): 1e-5, (1, 2): -8e-6}, {(2, 0): -3e-4, (1, 1): 5e-4, (0, 2): 7e-4, (0, 3): -9e-6, (2, 1): 6e-6})


def _polynomial_sql(terms, u: str, v: str) -> str:
    return " + ".join("*".join([f"({c!r}::DOUBLE)", *[u] * p, *[v] * q]) for (p, q), c in terms.items())


_A, _B = (_polynomial_sql(t, "u", "v") for t in (SIP.a, SIP.b))
#: u and v by repeated substitution, each of which leaves a tenth of the error or less
_SUBSTITUTED = ",".join(f"s{n} AS (SELECT id, x, y, {_A} AS fu, {_B} AS fv, x - 22.3e0 - fu AS u, y - 17.6e0 - fv AS v FROM (SELECT id, x, y, u, v FROM s{n - 1}))" for n in range(1, 19))


@query(f"""WITH s0 AS (SELECT c_custkey AS id, CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey % 40 AS DOUBLE) AS y, x - 22.3e0 AS u, y - 17.6e0 AS v FROM customer), {_SUBSTITUTED},
t AS (SELECT id, 20e0 + 2e0 * (u + {_A}) AS tx, 30e0 + 2e0 * (v + {_B}) AS ty FROM s0)
SELECT id, {rounded_sql("tx", 4)} AS plain_x, {rounded_sql("ty", 4)} AS plain_y, {rounded_sql("22.3e0 + u", 4)} AS seen_x, {rounded_sql("17.6e0 + v", 4)} AS seen_y FROM t JOIN s18 USING (id)""")
def distorted_pixels(spark, sf_dir):
    """Pixels of a distorted detector in a plain frame of half its pixel size, and the detector pixels where plain ones are seen."""
    plain = geometry.Frame((120.0, 10.0), (21.0, 31.0), ((-0.0005, 0.0), (0.0, 0.0005)), 80, 100)
    same = geometry.Frame((120.0, 10.0), (23.3, 18.6), ((-0.001, 0.0), (0.0, 0.001)), 40, 50)
    seen = replace(same, sip=SIP)
    cells = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).cast("double").alias("x"), (F.col("c_custkey") % 40).cast("double").alias("y")
    )
    there, back = geometry.map_pixels(F.col("x"), F.col("y"), seen, plain), geometry.map_pixels(F.col("x"), F.col("y"), same, seen)
    return cells.select("id", *[rounded(c, 4).alias(n) for c, n in zip((*there, *back), ("plain_x", "plain_y", "seen_x", "seen_y"))])


_PLACE = "CAST(c_custkey * 37 % 3600 AS DOUBLE) / 10e0 AS ra, CAST(c_custkey * 11 % 1600 AS DOUBLE) / 10e0 - 80e0 AS dec"


def _places(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        (F.col("c_custkey") * 37 % 3600).cast("double").__truediv__(10.0).alias("ra"),
        ((F.col("c_custkey") * 11 % 1600).cast("double") / 10.0 - 80.0).alias("dec"),
    )


@query(f"""WITH p AS (SELECT c_name AS name, {_PLACE} FROM customer)
SELECT concat('/exposures/', name) AS file_path FROM p WHERE name LIKE '%7%' AND degrees(2e0 * asin(sqrt(least(1e0, power(sin((radians(10.05e0) - radians(dec)) / 2e0), 2) + cos(radians(10.05e0)) * cos(radians(dec)) * power(sin((radians(120.05e0) - radians(ra)) / 2e0), 2))))) < 40e0""")
def cone_search(spark, sf_dir):
    return readers.catalogue(_places(spark, sf_dir), 120.05, 10.05, 40.0, "/exposures/", "7")


_COS = "(sin(radians(10e0)) * sin(radians(dec)) + cos(radians(10e0)) * cos(radians(dec)) * cos(radians(ra - 120e0)))"


@query(f"""WITH p AS (SELECT c_custkey AS id, {_PLACE} FROM customer), q AS (SELECT id, ra, dec, {_COS} AS c FROM p)
SELECT id, {rounded_sql("degrees(cos(radians(dec)) * sin(radians(ra - 120e0)) / c)", 4)} AS xi,
{rounded_sql("degrees((cos(radians(10e0)) * sin(radians(dec)) - sin(radians(10e0)) * cos(radians(dec)) * cos(radians(ra - 120e0))) / c)", 4)} AS eta FROM q WHERE c > 0.2e0""")
def tan_project(spark, sf_dir):
    p = _places(spark, sf_dir)
    xi, eta = geometry.plane(F.col("ra"), F.col("dec"), 120.0, 10.0)
    near = F.cos(F.radians(geometry.separation(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(10.0)))) > 0.2
    return p.where(near).select("id", rounded(xi, 4).alias("xi"), rounded(eta, 4).alias("eta"))


@query(f"""WITH p AS (SELECT c_nationkey AS grp, {_PLACE} FROM customer), q AS (SELECT grp, ra, dec, {_COS} AS c FROM p),
t AS (SELECT grp, degrees(cos(radians(dec)) * sin(radians(ra - 120e0)) / c) AS xi, degrees((cos(radians(10e0)) * sin(radians(dec)) - sin(radians(10e0)) * cos(radians(dec)) * cos(radians(ra - 120e0))) / c) AS eta FROM q WHERE c > 0.2e0)
SELECT grp, CAST(ceil(max(-xi / 0.5e0) - min(-xi / 0.5e0)) + 1 AS BIGINT) AS nx, CAST(ceil(max(eta / 0.5e0) - min(eta / 0.5e0)) + 1 AS BIGINT) AS ny FROM t GROUP BY grp""")
def frame_extent(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp")).join(_places(spark, sf_dir), "id")
    frame = geometry.Frame((120.0, 10.0), (1, 1), ((-0.5, 0.0), (0.0, 0.5)), 1, 1)
    x, y = frame.pixel(F.col("ra"), F.col("dec"))
    near = F.cos(F.radians(geometry.separation(F.col("ra"), F.col("dec"), F.lit(120.0), F.lit(10.0)))) > 0.2
    spans = p.where(near).groupBy("grp").agg((F.ceil(F.max(x) - F.min(x)) + 1).alias("nx"), (F.ceil(F.max(y) - F.min(y)) + 1).alias("ny"))
    return spans


_SPECTRUM = """s AS (SELECT vec_id, list_sort(list_transform(embedding[1:10], lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000e0) AS DOUBLE))) AS wave, list_transform(embedding[11:20], lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000e0) AS DOUBLE)) AS data FROM embeddings),
i AS (SELECT *, greatest(2, least(10, coalesce(list_position(list_transform(wave, lambda v: v >= 0e0), true), 10))) AS hi FROM s)"""


@query(f"""WITH {_SPECTRUM} SELECT vec_id, CASE WHEN wave[hi] - wave[hi - 1] > 0 THEN data[hi - 1] + (data[hi] - data[hi - 1]) * ((0e0 - wave[hi - 1]) / (wave[hi] - wave[hi - 1])) ELSE data[hi - 1] END AS value FROM i""")
def spectral_interp(spark, sf_dir):
    whole = table(spark, sf_dir, "embeddings").withColumn("f", F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("double")))
    cubes = whole.select("vec_id", F.array_sort(F.slice("f", 1, 10)).alias("wave"), F.slice("f", 11, 10).alias("data"))
    return cubes.select("vec_id", spectral.at_wavelength(F.col("data"), F.col("wave"), F.lit(0.0)).alias("value"))


@query("""WITH h AS (SELECT event_type, CAST(CASE WHEN value = 100 THEN 19 ELSE floor(value / 5e0) END AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL)
SELECT event_type, bin, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY event_type) * 5e0 AS DOUBLE) AS density FROM h""")
def wave_hist(spark, sf_dir):
    return spectral.histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 20, by=["event_type"])


@query(f"""WITH {OBS_SQL}, {GRID_SQL} SELECT frame, ord, line, pix, CAST(v AS DOUBLE) * (CAST(raster AS DOUBLE) / CAST(chunk2 AS DOUBLE)) AS value FROM obs JOIN (SELECT cell, raster, chunk AS chunk2 FROM grid) ON cell = pix""")
def gain_recal(spark, sf_dir):
    g = grid(spark, sf_dir)
    old = g.select("det_y", "det_x", F.col("chunk").cast("double").alias("gain"))
    new = g.select("det_y", "det_x", F.col("raster").cast("double").alias("gain"))
    seen = obs(spark, sf_dir).select("frame", "ord", "line", "pix", F.col("ref_y").alias("det_y"), F.col("ref_x").alias("det_x"), F.col("v").cast("double").alias("value"))
    return sinks.recalibrated_gain(seen, old, new).select("frame", "ord", "line", "pix", "value")


@query("""SELECT o_orderkey AS id, CAST(o_orderkey % 1000 AS INTEGER) AS exp, CAST(o_custkey % 100 AS INTEGER) AS det FROM orders""")
def path_parse(spark, sf_dir):
    name = F.format_string("/run/exp_%04d_det_%02d.h5", F.col("o_orderkey") % 1000, F.col("o_custkey") % 100)
    found = readers.exposure_index(name)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), found["exp"].alias("exp"), found["det"].alias("det"))


@query("SELECT DISTINCT CAST(o_orderkey % 53 AS INTEGER) AS week FROM orders")
def week_numbers(spark, sf_dir):
    name = F.format_string("/run/level2_2025W%02d_%d_1.fits", F.col("o_orderkey") % 53, F.col("o_orderkey"))
    return readers.week_numbers(table(spark, sf_dir, "orders").select(name.alias("file_path")))


@query("""WITH f AS (SELECT DISTINCT concat('/d/', c_name) AS file_path FROM customer WHERE NOT (c_name LIKE '%1%' AND c_name LIKE '%2%'))
SELECT concat('/nvme/', substr(file_path, 4)) AS file_path, CAST(row_number() OVER (ORDER BY file_path) - 1 AS INTEGER) AS frame FROM f""")
def reindex_frames(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("/d/"), "c_name").alias("file_path")).distinct()
    kept = readers.numbered(sinks.dropped(files, "1", "2"))
    return kept.select(sinks.remapped(F.col("file_path"), "/d/", "/nvme/").alias("file_path"), "frame")


@query(f"""WITH {OBS_SQL}, m AS (SELECT frame, chunk, CAST(floor(CAST(sum(v) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS off FROM obs WHERE (dq & 8) = 0 GROUP BY ALL),
d AS (SELECT ref_y, ref_x, w, v - off AS v FROM obs JOIN m USING (frame, chunk) WHERE (dq & 8) = 0),
s AS (SELECT ref_y, ref_x, CAST(sum(w) AS DOUBLE) AS sw, CAST(sum(w * v) AS DOUBLE) AS a, CAST(sum(w * v * v) AS DOUBLE) AS b FROM d GROUP BY ALL),
t AS (SELECT ref_y, ref_x, a / sw AS mean, sqrt(greatest(b / sw - (a / sw) * (a / sw), 0e0)) AS std FROM s)
SELECT ref_y, ref_x, CASE WHEN sum(k) > 0 THEN CAST(sum(k * v) AS DOUBLE) / CAST(sum(k) AS DOUBLE) ELSE 0e0 END AS data, CAST(sum(k) AS BIGINT) AS weight
FROM (SELECT ref_y, ref_x, v, CASE WHEN abs(v - mean) <= 2e0 * std THEN w ELSE 0 END AS k FROM d JOIN t USING (ref_y, ref_x)) GROUP BY ref_y, ref_x""")
def guess_and_coadd(spark, sf_dir):
    """The offsets' first guess, taken off, and the clipped mean of what is left. ``calibrate_and_coadd`` solves."""
    good = obs(spark, sf_dir).where("(dq & 8) = 0")
    offsets = good.groupBy("frame", "chunk").agg(F.floor(F.sum("v") / F.count("*")).alias("off"))
    left = good.join(offsets, ["frame", "chunk"]).withColumn("v", F.col("v") - F.col("off"))
    return coadd.coadd_sigma_clip(left, 2.0, value="v", weight="w", exact=True)


@query(f"""WITH {OBS_SQL}, s AS (SELECT ref_y, ref_x, CAST(sum(w) AS DOUBLE) AS sw, CAST(sum(w * v) AS DOUBLE) AS a, CAST(sum(w * v * v) AS DOUBLE) AS b FROM obs GROUP BY ALL)
SELECT ref_y, ref_x, a / sw AS data, sqrt(greatest(b / sw - (a / sw) * (a / sw), 0e0)) AS std, CAST(sw AS BIGINT) AS weight FROM s""")
def incremental_coadd(spark, sf_dir):
    """Sums of the frames in four batches, merged: what the streaming co-add keeps."""
    seen = obs(spark, sf_dir)
    batches = None
    for k in range(4):
        part = stream.running_sums(seen.where(F.col("frame") % 4 == k), value="v", weight="w")
        batches = part if batches is None else batches.unionByName(part)
    return stream.maps(stream.merged(batches))


@query("""WITH d AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS layer FROM events)
SELECT user_id, list(floor(value * 100e0) ORDER BY layer)[2] AS second, CAST(count(*) AS BIGINT) AS layers FROM d GROUP BY user_id""")
def spectral_cube(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    layers = table(spark, sf_dir, "events").select(
        "user_id", F.floor(F.col("value") * 100).cast("double").alias("value"), F.col("value").alias("wave"), F.row_number().over(line).alias("layer")
    )
    cubes = spectral.cube(layers, keys=["user_id"])
    return cubes.select("user_id", F.get("data", F.lit(1)).alias("second"), F.size("data").cast("bigint").alias("layers"))
