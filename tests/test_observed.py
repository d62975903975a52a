"""The solution without A: equal to that with A, on its own buckets, with no row moved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.operators import solver, system
from loomsky.operators.store import Store

NY, NX, CHUNKS, FRAMES = 4, 5, 3, 6
N_SKY = NY * NX


@pytest.fixture(scope="module")
def observed(spark):
    r = np.random.default_rng(7)
    rows = [
        (f, y, x, (x + f) % CHUNKS, float(r.normal(5, 2)), float(r.integers(0, 4)))
        for f in range(FRAMES) for y in range(NY) for x in range(NX) if r.random() < 0.7
    ]
    return spark.createDataFrame(rows, "frame long, ref_y long, ref_x long, chunk long, value double, weight double")


def system_of(observed, spark, damped):
    """The same system both ways: A and b, and rows with what is beside them."""
    a, b = system.data_rows(system.dense_rows(observed, "frame", ["ref_y", "ref_x"]), NY, NX, CHUNKS)
    rows = system.observed_rows(observed, NY, NX, CHUNKS)
    reg = system.regularisation_rows(observed, spark.createDataFrame([(0, 1), (1, 2)], "chunk_i long, chunk_j long"), 0.7, N_SKY, CHUNKS)
    reg = reg.select((10_000 + F.col("frame") * 9 + F.col("chunk_i") * 3).alias("row"), "col", "val")
    frames = observed.select("frame").distinct().withColumn("bias", F.lit(0.5))
    means, right = system.mean_rows(frames, N_SKY, CHUNKS)
    beside = reg.union(means.select(F.col("row") + 20_000, "col", "val")), right.select((F.col("row") + 20_000).alias("row"), "val")
    damp = system.damping_rows(system.entry_counts(a), damped, N_SKY)
    a = a.union(beside[0]).union(damp.select(F.col("row") + 30_000, "col", "val"))
    b = b.union(beside[1])
    rows = rows.union(damp.select(F.col("col").alias("sky"), F.lit(None).cast("long"), F.col("val").alias("weight"), F.lit(0.0)))
    return a, b, rows, beside


@pytest.mark.parametrize("method, precondition", [("lsqr", True), ("lsmr", False)])
def test_every_step_is_that_with_a(observed, spark, method, precondition):
    a, b, rows, beside = system_of(observed, spark, 0.3)
    x0 = spark.createDataFrame([(N_SKY + i, float(i % 4)) for i in range(FRAMES * CHUNKS)], "col long, value double")
    options = dict(method=method, precondition=precondition, x0=x0, damp=0.1, atol=0.0, btol=0.0, iterations=3)
    expected = solver.solve(a, b, **options)
    found = solver.solve_observed(rows, more=beside, **options)
    assert np.allclose(found.residuals, expected.residuals)
    want, got = ({r.col: r.value for r in s.x.collect()} for s in (expected, found))
    assert want.keys() == got.keys() and all(abs(got[c] - v) < 1e-9 for c, v in want.items())


def test_many_offsets_are_joined_by_shuffling(observed, spark, monkeypatch):
    _, _, rows, beside = system_of(observed, spark, 0.3)
    one = solver.solve_observed(rows, more=beside, atol=0.0, btol=0.0, iterations=2)
    monkeypatch.setattr(solver, "SMALL", 1)
    other = solver.solve_observed(rows, more=beside, atol=0.0, btol=0.0, iterations=2)
    assert np.allclose(one.residuals, other.residuals)


def test_equals_the_dense_solution_and_says_so(observed, spark):
    a, _, rows, _ = system_of(observed, spark, 1e-2)
    found = solver.solve_observed(rows, method="lsqr", atol=1e-12, btol=1e-12, iterations=80)
    assert found.converged
    lines = [r for r in rows.collect() if r.weight]
    m, v = np.zeros((len(lines), N_SKY + FRAMES * CHUNKS)), np.array([r.weight * r.value for r in lines])
    for i, r in enumerate(lines):
        m[i, r.sky] = r.weight
        if r.off is not None:
            m[i, r.off] = r.weight
    x = np.zeros(m.shape[1])
    for r in found.x.collect():
        x[r.col] = r.value
    assert np.allclose(m @ x, m @ np.linalg.lstsq(m, v, rcond=None)[0], atol=1e-5)


def test_odd_rows_and_none(spark):
    ddl = "sky long, off long, weight double, value double, u string"
    rows = spark.createDataFrame([(0, 2, 1.0, 3.0, "a"), (1, 2, 1.0, float("nan"), "b"), (None, 2, 1.0, 1.0, "c"), (1, None, 2.0, 4.0, "d"), (0, 2, None, 1.0, "e")], ddl)
    found = solver.solve_observed(rows, atol=1e-12, btol=1e-12)
    got = {r.col: r.value for r in found.x.collect()}
    assert got[0] + got[2] == pytest.approx(3) and got[1] == pytest.approx(4)
    assert solver.solve_observed(rows.limit(0)).x.isEmpty()
    with pytest.raises(ValueError):
        solver.solve_observed(rows, method="cg")


def test_only_sums_by_offset_are_shuffled(observed, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    store = Store(spark)
    try:
        rows = system.observed_rows(observed.where("weight > 0"), NY, NX, CHUNKS).withColumns({"s": F.lit(1.0), "o": F.lit(1.0), "u": F.col("value")})
        cols = rows.select(F.col("sky").alias("col"), F.lit(True).alias("is_sky")).union(rows.select("off", F.lit(False))).distinct()
        norms = store.keep_dealt(cols.withColumn("norm", F.lit(1.0)).repartition(4, "col"), "col", 4, "norms")
        state = store.keep_dealt(norms.withColumn("v", F.lit(1.0)), "col", 4, "state")
        job = solver._Observed(store, 4, norms, small=True)
        job.rows = store.keep_dealt(rows.select("sky", "off", "s", "o", "u").repartition(4, "sky"), "sky", 4, "rows")
        forward, backward = ([x for x in plan(d).splitlines() if "Exchange" in x and "BroadcastExchange" not in x] for d in (job.product(state, 0.5), job.added(state)))
        assert forward == []
        assert len(backward) == 1 and "hashpartitioning(off" in backward[0]
    finally:
        store.drop("norms", "state", "rows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
