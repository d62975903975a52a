"""Bit masks and invalid values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsky.functions import masks


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=20))
def test_packing_undoes_expanding(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "dq long")
    rows = df.select("dq", masks.pack_bits(masks.expand_bits(F.col("dq"))).alias("back")).collect()
    assert all(r.dq == r.back for r in rows)


def test_ignored_bits_and_names(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (1 << 31,), (None,)], "dq long")
    got = [r.bad for r in df.select(masks.is_flagged(F.col("dq"), [0, "hot"], {"hot": 31}).alias("bad")).collect()]
    assert got == [False, False, True, True, False, False]


def test_invalid_by_type(spark):
    df = spark.createDataFrame([(1.0, 1, "a"), (float("nan"), -9999, "b"), (None, None, None)], "f double, i int, s string")
    assert [r[0] for r in df.select(masks.invalid(df, "f")).collect()] == [False, True, True]
    assert [r[0] for r in df.select(masks.invalid(df, "i")).collect()] == [False, True, True]
    with pytest.raises(TypeError):
        masks.invalid(df, "s")


def test_nan_has_no_weight_and_zero_the_largest(spark):
    df = spark.createDataFrame([(2.0, 1.0), (float("nan"), 1.0), (0.0, 1.0)], "value double, weight double")
    assert [tuple(r) for r in masks.nan_to_zero(df).collect()] == [(2.0, 1.0), (0.0, 0.0), (0.0, 1.0)]
    assert [r[0] for r in df.select(masks.inverse_square_weight(F.col("value"))).collect()] == [0.25, 0.0, masks.LARGEST]


def test_channel_mask_is_padded_and_cut_at_the_ends(spark):
    got = {r.chunk for r in masks.channel_mask(spark, [1], n_sub=10, pad=3).where("valid").collect()}
    assert got == set(range(0, 14))
    assert masks.channel_mask(spark, [17], pad=3).count() == 172


def test_missing_astrometry_is_rejected(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "f int")
    assert [r[0] for r in df.select(masks.header_flag_ok(F.col("f"))).collect()] == [True, False, False]
