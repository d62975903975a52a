"""Co-addition of a stream of observations: sums grow with each micro-batch, and maps follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coadd import PIXEL, ratio


def running_sums(obs: DataFrame, *, keys: Sequence[str] = PIXEL, value: str = "value", weight: str = "weight") -> DataFrame:
    """``keys, sum_w, sum_wv, sum_wvv`` of a stream, to be written in update or complete mode. The state has a row for each pixel."""
    w, v = F.col(weight), F.col(value)
    return obs.groupBy(*keys).agg(F.sum(w).alias("sum_w"), F.sum(w * v).alias("sum_wv"), F.sum(w * v * v).alias("sum_wvv"))


def windowed_sums(obs: DataFrame, time: str, window: str, late: str, *, keys: Sequence[str] = PIXEL, value: str = "value", weight: str = "weight") -> DataFrame:
    """As ``running_sums``, for each span of ``window``, which is given out once rows can be at most ``late`` late; for append mode."""
    w, v = F.col(weight), F.col(value)
    spans = obs.withWatermark(time, late).groupBy(F.window(time, window).alias("span"), *keys)
    return spans.agg(F.sum(w).alias("sum_w"), F.sum(w * v).alias("sum_wv"), F.sum(w * v * v).alias("sum_wvv"))


def merged(sums: DataFrame, *, keys: Sequence[str] = PIXEL) -> DataFrame:
    """The sums of several spans or batches as one."""
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("sum_w", "sum_wv", "sum_wvv")])


def maps(sums: DataFrame, *, keys: Sequence[str] = PIXEL) -> DataFrame:
    """``keys, data, std, weight`` from sums."""
    mean = ratio(F.col("sum_wv"), F.col("sum_w"))
    square = F.greatest(ratio(F.col("sum_wvv"), F.col("sum_w")) - mean * mean, F.lit(0.0))
    return sums.select(*keys, mean.alias("data"), F.sqrt(square).alias("std"), F.col("sum_w").alias("weight"))
