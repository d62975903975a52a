"""The solution in blocks of the sky: each step that with A, and observations that aren't dealt twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.operators import blocks, solver, system
from loomsky.plans.pipeline import Calibrator

from .test_observed import CHUNKS, FRAMES, N_SKY, NX, NY, observed, plan, system_of  # noqa: F401


@pytest.mark.parametrize("method, precondition, width", [("lsqr", True, 3), ("lsmr", False, 100)])
def test_every_step_is_that_with_a(observed, spark, method, precondition, width):  # noqa: F811
    a, b, rows, beside = system_of(observed, spark, 0.3)
    x0 = spark.createDataFrame([(N_SKY + i, float(i % 4)) for i in range(FRAMES * CHUNKS)], "col long, value double")
    options = dict(method=method, precondition=precondition, x0=x0, damp=0.1, atol=0.0, btol=0.0, iterations=4)
    expected = solver.solve(a, b, **options)
    found = blocks.solve_blocks(rows, width, more=beside, **options)
    assert np.allclose(found.residuals, expected.residuals)
    want, got = ({r.col: r.value for r in s.x.collect()} for s in (expected, found))
    assert want.keys() == got.keys() and all(abs(got[c] - v) < 1e-9 for c, v in want.items())


def test_odd_rows_and_none(spark):
    ddl = "sky long, off long, weight double, value double, u string"
    rows = spark.createDataFrame([(0, 2, 1.0, 3.0, "a"), (1, 2, 1.0, float("nan"), "b"), (None, 2, 1.0, 1.0, "c"), (1, None, 2.0, 4.0, "d"), (0, 2, None, 1.0, "e")], ddl)
    found = blocks.solve_blocks(rows, 1, atol=1e-12, btol=1e-12)
    got = {r.col: r.value for r in found.x.collect()}
    assert found.converged and got[0] + got[2] == pytest.approx(3) and got[1] == pytest.approx(4)
    assert blocks.solve_blocks(rows.limit(0), 1).x.isEmpty()
    with pytest.raises(ValueError):
        blocks.solve_blocks(rows, 1, method="cg")


def test_blocks_stay_where_they_are(observed, spark):  # noqa: F811
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    _, _, rows, _ = system_of(observed, spark, 0.3)
    store = solver.Store(spark)
    try:
        job = blocks._Blocks(store, rows.withColumn("off", F.col("off").cast("long")).select("sky", "off", F.col("weight").cast("double"), F.col("value").cast("double")), 3, None, True)
        moved = [x for x in plan(job._handed(job.norms.select("col", F.col("norm").alias("v")))).splitlines() if "Exchange" in x]
        assert len(moved) == 1 and "hashpartitioning(block" in moved[0]  # unknowns, on their way to blocks
    finally:
        store.drop("blocks", "seats", "norms")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_calibration_needs_no_a(observed, spark):  # noqa: F811
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "chunk_i long, chunk_j long")
    means = spark.createDataFrame([(f, 0.5) for f in range(FRAMES)], "frame long, value double")
    cal = Calibrator(observed, NY, NX, CHUNKS).setup(outlier_threshold=1.5, adjacency=pairs, reg_weight=0.7, mean_offsets=means, damp_weight=0.3)
    options = dict(method="lsqr", atol=0.0, btol=0.0, iterations=3)
    guess = system.first_guess(cal.a, cal.b, N_SKY)
    expected = solver.solve(cal.a, cal.b, x0=guess, **options)
    cal.a = cal.b = None
    found = cal.apply(**options)
    assert np.allclose(found.residuals, expected.residuals)
    want, got = ({r.col: r.value for r in s.x.collect()} for s in (expected, found))
    assert want.keys() == got.keys() and all(abs(got[c] - v) < 1e-9 for c, v in want.items())


def test_bounds_of_outliers(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0), (0, 4.0), (0, nan), (0, None), (0, 2.5), (0, 9.0), (1, 3.0), (2, nan)], "frame int, value double")
    want = {(r.frame, r.median, r.mad) for r in system.outliers(df, 3.0).select("frame", "median", "mad").distinct().collect()}
    assert {(r.frame, r.median, r.mad) for r in system.outlier_bounds(df).collect()} == want == {(0, 3.25, 1.5), (1, 3.0, 0.0), (2, None, None)}
