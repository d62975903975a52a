"""Connected groups of a system and their open constants; solutions of the full queries against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.operators import gauges, solver, system
from loomsky.queries import QUERIES
from loomsky.queries.solving import WIDTH, _system
from loomsky.sources.views import CHUNKS

from .conftest import SF


def planted(spark, groups=2, frames=4, pixels=6, n_chunks=2, seed=3):
    """Observations of ``groups`` that share no pixel, of a sky and offsets; frame and pixel numbers are interleaved."""
    rng = np.random.default_rng(seed)
    sky, offset = rng.normal(0, 5, groups * pixels), rng.normal(0, 3, (groups * frames, n_chunks))
    rows = []
    for g in range(groups):
        for f in range(frames):
            for p in range(pixels):
                if rng.random() < 0.8:
                    for c in range(n_chunks):
                        at, frame = p * groups + g, f * groups + g
                        rows.append((len(rows), frame, 0, at, c, float(sky[at] + offset[frame, c] + rng.normal(0, 0.1)), float(rng.integers(1, 5))))
    obs = spark.createDataFrame(rows, "row long, frame int, ref_y int, ref_x int, chunk int, value double, weight double")
    return system.data_rows(obs, 1, groups * pixels, n_chunks), groups * pixels, groups * (pixels + frames * n_chunks)


def dense(a, b, n):
    rows = {r.row: i for i, r in enumerate(b.collect())}
    m, right = np.zeros((len(rows), n)), np.zeros(len(rows))
    for r in a.collect():
        m[rows[r.row], r.col] += r.val
    for r in b.collect():
        right[rows[r.row]] = r.val
    return m, right


def test_two_groups_solve_to_the_centred_dense_solution(spark):
    (a, b), n_sky, n = planted(spark)
    found = gauges.groups(gauges.links(a, n_sky))
    group = {r.col: r.gauge for r in found.collect()}
    assert len(group) == n and sorted(set(group.values())) == [0, 1]
    m, right = dense(a, b, n)
    assert n - np.linalg.matrix_rank(m) == 2
    want = np.linalg.lstsq(m, right, rcond=None)[0]
    for g in (0, 1):
        own = np.array([c for c in range(n) if group[c] == g])
        mean = want[own[own >= n_sky]].mean()
        want[own] += np.where(own < n_sky, mean, -mean)
    for method in ("lsqr", "lsmr"):
        start = a.select("col").distinct().withColumn("value", F.rand(1) * 50)  # from anywhere
        solved = solver.solve(a, b, method=method, x0=start, atol=1e-12, btol=1e-12, iterations=200)
        got = {r.col: r.value for r in gauges.centred(solved.x, found, n_sky).collect()}
        assert [got[c] for c in range(n)] == pytest.approx(want.tolist(), abs=1e-5)


def test_long_chains_and_lone_columns(spark):
    chain = [(i, 1000 + i) for i in range(200)] + [(i + 1, 1000 + i) for i in range(199)] + [(500, 1900)]
    found = gauges.groups(spark.createDataFrame(chain, "sky long, offset long"))
    got = {r.col: r.gauge for r in found.collect()}
    assert set(got.values()) == {0, 500} and got[1199] == 0 and got[1900] == 500
    assert gauges.groups(found.limit(0).select(F.col("col").alias("sky"), F.col("gauge").alias("offset"))).isEmpty()
    x = spark.createDataFrame([(3, 1.0), (1003, 5.0), (1004, 7.0), (77_777, 9.0)], "col long, value double")
    assert {r.col: r.value for r in gauges.centred(x, found, 1000).collect()} == {3: 7.0, 1003: -1.0, 1004: 1.0, 77_777: 9.0}


@pytest.mark.parametrize("method", ["lsqr", "lsmr"])
def test_full_queries_against_a_dense_solution(spark, method):
    a, b, n_sky = _system(spark, SF)
    rows = {r.row: i for i, r in enumerate(b.collect())}
    cols = {c: i for i, c in enumerate(sorted({r.col for r in a.select("col").distinct().collect()}))}
    m, right, x0 = np.zeros((len(rows), len(cols))), np.zeros(len(rows)), np.zeros(len(cols))
    for r in a.collect():
        m[rows[r.row], cols[r.col]] += r.val
    for r in b.collect():
        right[rows[r.row]] = r.val
    for r in system.first_guess(a, b, n_sky).collect():
        x0[cols[r.col]] = r.value
    norm = np.sqrt((m * m).sum(0))
    p = m / norm
    y = np.linalg.solve(p.T @ p + 1e-6 * np.eye(len(cols)), p.T @ (right - m @ x0))
    want = dict(zip(cols, x0 + y / norm))
    got = QUERIES[f"{method}_full"](spark, SF).collect()
    assert len(got) == len(cols)
    worst = max(abs(r.value - want[r.i * WIDTH + r.j if r.part == "sky" else n_sky + r.i * CHUNKS + r.j]) for r in got)
    assert worst < 0.01 * np.std(list(want.values()))


def test_a_solution_that_does_not_converge_is_no_result(spark, monkeypatch):
    monkeypatch.setattr("loomsky.queries.solving.MOST_STEPS", 2)
    with pytest.raises(RuntimeError, match="did not converge in 2 steps"):
        QUERIES["lsqr_full"](spark, SF)
