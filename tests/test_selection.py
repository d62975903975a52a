"""Order statistics by refinement, against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsky.operators import selection, system


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(8)
    data = {
        "normal": rng.normal(0, 1, 900), "ties": np.repeat([1.0, 2.0, 2.0, 2.0, 9.0], 150), "one": [4.5], "two": [1.0, 2.0], "same": [3.0] * 400,
        "wide": np.concatenate([rng.normal(0, 1e-12, 300), rng.normal(0, 1, 300), [1e300, -1e300, 1.7e308, -1.7e308]]), "close": 1 + np.arange(200) * 2.0**-52,
        None: rng.integers(0, 50, 333).astype(float),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("one", math.nan), ("one", None), ("none", None), ("none", math.nan)]
    return data, spark.createDataFrame(rows, "g string, x double")


def test_quantiles(groups):
    data, df = groups
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.value for r in selection.quantiles(df, ["g"], "x", shares).collect()}
    want = {(r.g, s): r.p[i] for r in df.where("x is not null and not isnan(x)").groupBy("g").agg(F.percentile("x", shares).alias("p")).collect() for i, s in enumerate(shares)}
    assert set(got) == set(want) == {(k, s) for k in data for s in shares}
    for k in want:
        if k[0] != "wide" or k[1] in (0.25, 0.5, 0.9):
            assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-24), k
    assert got["wide", 1.0] == 1.7e308 and got["wide", 0.0] == -1.7e308


def test_all_rows_as_one_group(groups):
    _, df = groups
    some = df.where("g = 'normal'")
    got = {r.share: r.value for r in selection.quantiles(some, [], F.col("x") * 2, [0.5, 0.3]).collect()}
    values = np.array([r.x for r in some.collect()]) * 2
    assert got == pytest.approx({s: np.quantile(values, s) for s in (0.5, 0.3)})
    assert selection.quantiles(df.limit(0), ["g"], "x", [0.5]).isEmpty()


def test_spread_outliers_are_the_same(spark):
    rng = np.random.default_rng(5)
    rows = [(f, i, float(v)) for f, n in ((0, 700), (1, 30), (2, 1)) for i, v in enumerate(rng.standard_t(2, n))] + [(1, 99, math.nan), (3, 0, math.nan), (1, 98, None)]
    df = spark.createDataFrame(rows, "frame int, i int, value double")
    columns = ["frame", "i", "median", "mad", "is_outlier"]
    one, other = (sorted(map(str, system.outliers(df, 2.5, spread=s).select(*columns).collect())) for s in (False, True))
    assert one == other and len(one) == len(rows)


def test_no_task_holds_a_group(groups):
    _, df = groups
    plan = selection.quantiles(df, ["g"], "x", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect" not in plan and "percentile" not in plan
