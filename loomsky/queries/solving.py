"""Queries of the least-squares system and its solution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks
from ..operators import blocks, chunks, coadd, gauges, solver, system
from ..plans.pipeline import Calibrator
from ..sources.views import CHUNKS, FRAMES_SQL, GRID_SQL, OBS_SQL, WIDTH, frames, grid, obs, table
from . import query

#: rows of the sky that the queries solve for: the raster's own at any scale
NY_SQL = f"(SELECT max(p_partkey) // {WIDTH} + 1 FROM part)"


def _ny(spark, sf_dir) -> int:
    return table(spark, sf_dir, "part").agg(F.expr(f"max(p_partkey) div {WIDTH} + 1")).first()[0]


_ROWS = f"""{OBS_SQL}, size AS (SELECT {NY_SQL} * {WIDTH} AS n_sky),
numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY frame, ord, line, pix) - 1 AS BIGINT) AS row FROM obs WHERE w > 5)"""
_A = f"""a AS (SELECT row, pix AS col, w AS val FROM numbered UNION ALL SELECT row, n_sky + frame * {CHUNKS} + chunk, w FROM numbered, size)"""
_B = "b AS (SELECT row, w * v AS val FROM numbered)"


def _numbered(spark, sf_dir):
    return system.dense_rows(obs(spark, sf_dir).where("w > 5"), "frame", ["ord", "line", "pix"])


def _system(spark, sf_dir):
    ny = _ny(spark, sf_dir)
    a, b = system.data_rows(_numbered(spark, sf_dir), ny, WIDTH, CHUNKS, value="v", weight="w")
    return a, b, ny * WIDTH


@query(f"WITH {_ROWS}, {_A}, {_B} SELECT a.row, a.col, a.val, b.val AS rhs FROM a JOIN b ON a.row = b.row")
def system_data_rows(spark, sf_dir):
    a, b, _ = _system(spark, sf_dir)
    a, b = system.cleaned(a, b)
    return a.join(b.withColumnRenamed("val", "rhs"), "row").select("row", "col", "val", "rhs")


@query(f"""WITH {OBS_SQL}, {GRID_SQL}, size AS (SELECT {NY_SQL} * {WIDTH} AS n_sky),
q AS (SELECT a.chunk % {CHUNKS} AS a, b.chunk % {CHUNKS} AS b FROM grid a JOIN grid b ON (a.det_y = b.det_y AND b.det_x = a.det_x + 1) OR (a.det_x = b.det_x AND b.det_y = a.det_y + 1)),
p AS (SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM q WHERE a <> b), f AS (SELECT DISTINCT frame FROM obs WHERE w > 5)
SELECT frame, i AS chunk_i, j AS chunk_j, n_sky + frame * {CHUNKS} + (CASE WHEN e = 0 THEN i ELSE j END) AS col, CASE WHEN e = 0 THEN 0.5e0 ELSE -0.5e0 END AS val
FROM f CROSS JOIN p CROSS JOIN size CROSS JOIN (SELECT unnest([0, 1]) AS e)""")
def system_reg_rows(spark, sf_dir):
    pairs = chunks.chunk_adjacency(grid(spark, sf_dir).withColumn("chunk", F.col("chunk") % CHUNKS))
    seen = obs(spark, sf_dir).where("w > 5")
    return system.regularisation_rows(seen, pairs, 0.5, _ny(spark, sf_dir) * WIDTH, CHUNKS)


@query(f"""WITH {FRAMES_SQL}, size AS (SELECT {NY_SQL} * {WIDTH} AS n_sky)
SELECT frame AS row, n_sky + frame * {CHUNKS} + c AS col, CAST(10 AS BIGINT) AS val, 10 * {CHUNKS} * bias AS rhs FROM frames CROSS JOIN size CROSS JOIN (SELECT unnest(range({CHUNKS})) AS c)""")
def system_mean_rows(spark, sf_dir):
    a, b = system.mean_rows(frames(spark, sf_dir), _ny(spark, sf_dir) * WIDTH, CHUNKS)
    return a.join(b.withColumnRenamed("val", "rhs"), "row").select("row", "col", F.col("val").cast("bigint").alias("val"), "rhs")


@query(f"WITH {_ROWS}, {_A} SELECT col AS row, col, sqrt(0.25e0 * CAST(count(*) AS DOUBLE)) AS val FROM a, size WHERE col < n_sky GROUP BY col")
def system_damp_rows(spark, sf_dir):
    a, _, n_sky = _system(spark, sf_dir)
    return system.damping_rows(system.entry_counts(a), 0.25, n_sky)


@query(f"""WITH {_ROWS}, {_A}, {_B}
SELECT a.col, CAST(sum(a.val * b.val) AS DOUBLE) / CAST(sum(a.val * a.val) AS DOUBLE) AS value FROM a JOIN b ON a.row = b.row, size WHERE col >= n_sky GROUP BY a.col""")
def x0_from_system(spark, sf_dir):
    a, b, n_sky = _system(spark, sf_dir)
    return system.first_guess(a, b, n_sky)


@query(f"""WITH {_ROWS}, {_A}, c AS (SELECT col, count(*) AS n FROM a GROUP BY col), {GRID_SQL}, z AS (SELECT chunk % {CHUNKS} AS chunk, count(*) AS size FROM grid GROUP BY 1)
SELECT (col - n_sky) // {CHUNKS} AS frame, (col - n_sky) % {CHUNKS} AS chunk, CAST(n AS BIGINT) AS n, CAST(n AS DOUBLE) / CAST(greatest(coalesce(z.size, 1), 1) AS DOUBLE) AS frac
FROM c CROSS JOIN size LEFT JOIN z ON z.chunk = (col - n_sky) % {CHUNKS} WHERE col >= n_sky""")
def pixel_counts(spark, sf_dir):
    a, _, n_sky = _system(spark, sf_dir)
    cells = grid(spark, sf_dir).withColumn("chunk", F.col("chunk") % CHUNKS)
    return system.coverage(system.entry_counts(a), cells, n_sky, CHUNKS)


@query(f"WITH {_ROWS}, {_A} SELECT col, sqrt(CAST(sum(val * val) AS DOUBLE)) AS norm FROM a GROUP BY col")
def col_norms(spark, sf_dir):
    return system.column_norms(_system(spark, sf_dir)[0])


@query(f"""WITH {_ROWS}, {_A}, x AS (SELECT DISTINCT col, col % 11 - 3 AS value FROM a) SELECT row, CAST(sum(val * value) AS BIGINT) AS val FROM a JOIN x USING (col) GROUP BY row""")
def spmv(spark, sf_dir):
    a, _, _ = _system(spark, sf_dir)
    return system.times(a, a.select("col", (F.col("col") % 11 - 3).alias("value")).distinct())


@query(f"""WITH {_ROWS}, {_A}, {_B} SELECT col, CAST(sum(a.val * (b.val % 1000)) AS BIGINT) AS value FROM a JOIN b ON a.row = b.row GROUP BY col""")
def spmv_t(spark, sf_dir):
    a, b, _ = _system(spark, sf_dir)
    return system.transposed_times(a, b.select("row", (F.col("val") % 1000).alias("val")))


def _step_sql(n: int) -> str:
    """Step ``n`` of LSQR: u, v and w of the step before it, and the numbers k, to those after it."""
    return f"""
y{n} AS MATERIALIZED (SELECT row, av - alpha * u AS u FROM (SELECT row, sum(val * v) AS av FROM p JOIN t{n - 1} USING (col) GROUP BY row) JOIN u{n - 1} USING (row), k{n - 1}),
s{n} AS MATERIALIZED (SELECT sqrt(sum(u * u)) AS beta FROM y{n}),
u{n} AS MATERIALIZED (SELECT row, u / beta AS u FROM y{n}, s{n}),
r{n} AS MATERIALIZED (SELECT col, atu - beta * v AS v, w, x FROM (SELECT col, sum(val * u) AS atu FROM p JOIN u{n} USING (row) GROUP BY col) JOIN t{n - 1} USING (col), s{n}),
g{n} AS MATERIALIZED (SELECT k.rho_bar, k.phi_bar, s.beta, sqrt(k.rho_bar * k.rho_bar + s.beta * s.beta) AS rho, (SELECT sqrt(sum(v * v)) FROM r{n}) AS alpha FROM k{n - 1} k, s{n} s),
k{n} AS MATERIALIZED (SELECT alpha, rho, beta / rho * alpha AS theta, rho_bar / rho * phi_bar AS phi, -rho_bar / rho * alpha AS rho_bar, beta / rho * phi_bar AS phi_bar FROM g{n}),
t{n} AS MATERIALIZED (SELECT col, v / alpha AS v, v / alpha - theta / rho * w AS w, x + phi / rho * w AS x FROM r{n}, k{n})"""


#: LSQR from 0 on the tables a and b, up to t0
_LSQR_SQL = """norms AS MATERIALIZED (SELECT col, sqrt(CAST(sum(val * val) AS DOUBLE)) AS norm FROM a GROUP BY col),
p AS MATERIALIZED (SELECT row, col, val / norm AS val FROM a JOIN norms USING (col)),
s0 AS MATERIALIZED (SELECT sqrt(sum(CAST(val AS DOUBLE) * CAST(val AS DOUBLE))) AS beta FROM b), u0 AS MATERIALIZED (SELECT row, val / beta AS u FROM b, s0),
r0 AS MATERIALIZED (SELECT col, sum(val * u) AS v FROM p JOIN u0 USING (row) GROUP BY col),
k0 AS MATERIALIZED (SELECT sqrt(sum(v * v)) AS alpha, sqrt(sum(v * v)) AS rho_bar, (SELECT beta FROM s0) AS phi_bar FROM r0),
t0 AS MATERIALIZED (SELECT col, v / alpha AS v, v / alpha AS w, 0e0 AS x FROM r0, k0)"""


_THREE_STEPS = f"""WITH {_ROWS}, {_A}, {_B}, {_LSQR_SQL},{",".join(map(_step_sql, (1, 2, 3)))}
SELECT CASE WHEN col < n_sky THEN 'sky' ELSE 'offset' END AS part, CASE WHEN col < n_sky THEN col // {WIDTH} ELSE (col - n_sky) // {CHUNKS} END AS i,
CASE WHEN col < n_sky THEN col % {WIDTH} ELSE (col - n_sky) % {CHUNKS} END AS j, CAST(round(x / norm) AS BIGINT) AS cents FROM t3 JOIN norms USING (col), size"""


@query(_THREE_STEPS)
def lsqr_3_iters(spark, sf_dir):
    """Three steps of LSQR from 0, to the cent."""
    a, b, n_sky = _system(spark, sf_dir)
    found = solver.solve(a, b, method="lsqr", atol=0.0, btol=0.0, iterations=3)
    return _parts(found, n_sky).select("part", "i", "j", F.round("value").cast("bigint").alias("cents"))


def _observed(spark, sf_dir):
    ny = _ny(spark, sf_dir)
    return system.observed_rows(obs(spark, sf_dir).where("w > 5"), ny, WIDTH, CHUNKS, value="v", weight="w"), ny * WIDTH


@query(_THREE_STEPS)
def lsqr_observed(spark, sf_dir):
    """As ``lsqr_3_iters``, on observations in buckets by sky pixel, without A."""
    rows, n_sky = _observed(spark, sf_dir)
    found = solver.solve_observed(rows, method="lsqr", atol=0.0, btol=0.0, iterations=3)
    return _parts(found, n_sky).select("part", "i", "j", F.round("value").cast("bigint").alias("cents"))


def _parts(found, n_sky):
    sky, offsets = solver.sky_and_offsets(found.x, WIDTH, n_sky, CHUNKS)
    return sky.select(F.lit("sky").alias("part"), F.col("ref_y").alias("i"), F.col("ref_x").alias("j"), "value").union(
        offsets.select(F.lit("offset"), "frame", "chunk", "value")
    )


@query(f"""WITH RECURSIVE {OBS_SQL}, size AS (SELECT {NY_SQL} * {WIDTH} AS n_sky),
e AS MATERIALIZED (SELECT DISTINCT pix AS u, n_sky + frame * {CHUNKS} + chunk AS v FROM obs, size WHERE w > 5 AND frame % 10 = pix % 10),
b AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT DISTINCT u AS col, u AS root FROM b UNION SELECT b.v, r.root FROM reach r JOIN b ON b.u = r.col)
SELECT col, min(root) AS gauge FROM reach GROUP BY col""")
def gauge_groups(spark, sf_dir):
    """The groups of a system in which a frame sees but the pixels that end with its own last digit."""
    seen = _numbered(spark, sf_dir).where("frame % 10 = pix % 10")
    n_sky = _ny(spark, sf_dir) * WIDTH
    a, _ = system.data_rows(seen, n_sky // WIDTH, WIDTH, CHUNKS, value="v", weight="w")
    return gauges.groups(gauges.links(a, n_sky))


#: of the joint calibration: outliers, weights of the adjacency's rows and of damping, coverage that an offset needs
OUTLIER, REG, DAMP, COVERED = 1.6, 40.0, 0.25, 0.02


@query(f"""WITH {OBS_SQL}, {GRID_SQL}, {FRAMES_SQL}, size AS (SELECT {NY_SQL} * {WIDTH} AS n_sky),
good AS (SELECT * FROM obs WHERE (dq & 8) = 0), m AS (SELECT frame, median(v) AS med FROM good GROUP BY frame),
d AS (SELECT frame, median(abs(v - med)) AS mad FROM good JOIN m USING (frame) GROUP BY frame),
kept AS MATERIALIZED (SELECT g.*, row_number() OVER () AS row FROM good g JOIN m USING (frame) JOIN d USING (frame) WHERE NOT abs(v - med) > {OUTLIER}e0 * 1.4826e0 * mad),
q AS (SELECT a.chunk % {CHUNKS} AS a, b.chunk % {CHUNKS} AS b FROM grid a JOIN grid b ON (a.det_y = b.det_y AND b.det_x = a.det_x + 1) OR (a.det_x = b.det_x AND b.det_y = a.det_y + 1)),
pairs AS (SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM q WHERE a <> b),
reg AS (SELECT -1 - (frame * {CHUNKS**2} + i * {CHUNKS} + j) AS row, frame * {CHUNKS} + n_sky + (CASE WHEN e = 0 THEN i ELSE j END) AS col, CASE WHEN e = 0 THEN {REG}e0 ELSE -{REG}e0 END AS val
  FROM (SELECT DISTINCT frame FROM kept) CROSS JOIN pairs CROSS JOIN size CROSS JOIN (SELECT unnest([0, 1]) AS e)),
seen AS (SELECT row, pix AS col, CAST(w AS DOUBLE) AS val FROM kept UNION ALL SELECT row, n_sky + frame * {CHUNKS} + chunk, w FROM kept, size UNION ALL SELECT * FROM reg),
counts AS MATERIALIZED (SELECT col, count(*) AS n FROM seen GROUP BY col),
means AS (SELECT 1000000000000 + frame AS row, n_sky + frame * {CHUNKS} + c AS col, 10e0 AS val, 10e0 * {CHUNKS} * bias AS rhs FROM frames CROSS JOIN size CROSS JOIN (SELECT unnest(range({CHUNKS})) AS c)),
damp AS (SELECT 2000000000000 + col AS row, col, sqrt({DAMP}e0 * CAST(n AS DOUBLE)) AS val FROM counts, size WHERE col < n_sky),
a AS MATERIALIZED (SELECT * FROM seen UNION ALL SELECT row, col, val FROM means UNION ALL SELECT * FROM damp),
b AS MATERIALIZED (SELECT row, CAST(w * v AS DOUBLE) AS val FROM kept UNION ALL SELECT DISTINCT row, rhs FROM means UNION ALL SELECT DISTINCT row, 0e0 FROM reg UNION ALL SELECT row, 0e0 FROM damp),
{_LSQR_SQL},{",".join(map(_step_sql, (1, 2, 3)))},
z AS (SELECT chunk % {CHUNKS} AS chunk, count(*) AS cells FROM grid GROUP BY 1),
off AS (SELECT (col - n_sky) // {CHUNKS} AS frame, (col - n_sky) % {CHUNKS} AS chunk, x / norm AS value, coalesce(n, 0) AS n FROM t3 JOIN norms USING (col) LEFT JOIN counts USING (col), size WHERE col >= n_sky),
valid AS (SELECT frame, off.chunk, value, CAST(n AS DOUBLE) / CAST(greatest(coalesce(cells, 1), 1) AS DOUBLE) >= {COVERED}e0 AS ok FROM off LEFT JOIN z ON z.chunk = off.chunk),
taken AS (SELECT frame, chunk, CASE WHEN ok THEN CAST(round(value - (SELECT avg(value) FROM valid WHERE ok)) AS BIGINT) ELSE 0 END AS o FROM valid),
left_over AS (SELECT ref_y, ref_x, w, v - coalesce(o, 0) AS v FROM good LEFT JOIN taken USING (frame, chunk)),
s AS (SELECT ref_y, ref_x, CAST(sum(w) AS DOUBLE) AS sw, CAST(sum(w * v) AS DOUBLE) AS a, CAST(sum(w * v * v) AS DOUBLE) AS b FROM left_over GROUP BY ALL),
t AS (SELECT ref_y, ref_x, a / sw AS mean, sqrt(greatest(b / sw - (a / sw) * (a / sw), 0e0)) AS std FROM s)
SELECT ref_y, ref_x, CASE WHEN sum(k) > 0 THEN CAST(sum(k * v) AS DOUBLE) / CAST(sum(k) AS DOUBLE) ELSE 0e0 END AS data, CAST(sum(k) AS BIGINT) AS weight
FROM (SELECT ref_y, ref_x, v, CASE WHEN abs(v - mean) <= 2e0 * std THEN w ELSE 0 END AS k FROM left_over JOIN t USING (ref_y, ref_x)) GROUP BY ref_y, ref_x""")
def calibrate_and_coadd(spark, sf_dir):
    """From observations to a map: outliers go, data, adjacency, mean and damping rows make the system, three steps of LSQR its solution, whose
    offsets, those of enough coverage and without their mean, are taken off to the cent; then the clipped mean."""
    seen, cells = obs(spark, sf_dir), grid(spark, sf_dir).withColumn("chunk", F.col("chunk") % CHUNKS)
    good = seen.where("(dq & 8) = 0").select("frame", "ref_y", "ref_x", "chunk", F.col("v").alias("value"), F.col("w").alias("weight"))
    job = Calibrator(good, _ny(spark, sf_dir), WIDTH, CHUNKS).setup(
        outlier_threshold=OUTLIER, adjacency=chunks.chunk_adjacency(cells), reg_weight=REG, mean_offsets=frames(spark, sf_dir).withColumnRenamed("bias", "value"), damp_weight=DAMP,
    )
    job.apply(method="lsqr", guess=False, atol=0.0, btol=0.0, iterations=3)
    valid = masks.valid_offsets(job.offsets(cells), threshold=COVERED, normalize=True)
    # a row for each frame, to be broadcast where they are few
    whole = [F.max(F.when(F.col("chunk") == c, F.round("value").cast("bigint"))).alias(f"o{c}") for c in range(CHUNKS)]
    taken = job.small(valid.groupBy("frame").agg(*whole))
    own = F.coalesce(*[F.when(F.col("chunk") == c, F.col(f"o{c}")) for c in range(CHUNKS)], F.lit(0))
    left = good.join(taken, "frame", "left").withColumn("value", F.col("value") - own)
    return coadd.coadd_sigma_clip(left, 2.0, value="value", weight="weight", exact=True)


#: steps that the full solutions may take; they raise if these aren't enough
MOST_STEPS = 100


def _solved(spark, sf_dir, method):
    rows, n_sky = _observed(spark, sf_dir)
    width = blocks.width_of(obs(spark, sf_dir), n_sky)
    found = blocks.solve_blocks(rows, width, method=method, x0=system.observed_guess(rows), damp=1e-3, atol=1e-6, btol=1e-6, iterations=MOST_STEPS)
    if not found.converged:
        raise RuntimeError(f"{method} did not converge in {found.iterations} steps")
    return _parts(found, n_sky)


@query()
def lsqr_full(spark, sf_dir):
    """The sky and the offsets of LSQR, run until it converges; compared with a dense solution in the tests."""
    return _solved(spark, sf_dir, "lsqr")


@query()
def lsmr_full(spark, sf_dir):
    """As ``lsqr_full``, by LSMR."""
    return _solved(spark, sf_dir, "lsmr")
