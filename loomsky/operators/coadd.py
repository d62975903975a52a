"""Co-addition of overlapping observations: weighted mean, deviation, clipped mean, more planes, wavelength moments.

The mean and the moments need one aggregation, whose partial sums are all that is shuffled. Deviation and clipping need the mean next to
each observation; there the observations are dealt by pixel once, and window sums, filters and aggregations follow on that one exchange.
A pixel has at most as many rows as frames observe it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIXEL = ("ref_y", "ref_x")


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or null."""
    return F.coalesce(F.when(b != 0, a / F.when(b != 0, b)), F.lit(0.0))


def coadd_mean(obs: DataFrame, *, keys: Sequence[str] = PIXEL, value: str = "value", weight: str = "weight", aux: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of each pixel: ``keys, data, weight`` and for each ``aux`` column its weighted mean. 0 where the weights sum to 0."""
    w = F.col(weight)
    sums = obs.groupBy(*keys).agg(
        F.sum(w * F.col(value)).alias("_wv"), F.sum(w).alias("_w"), *[F.sum(w * F.col(a)).alias(f"_{a}") for a in aux]
    )
    return sums.select(*keys, ratio(F.col("_wv"), F.col("_w")).alias("data"), F.col("_w").alias("weight"), *[ratio(F.col(f"_{a}"), F.col("_w")).alias(a) for a in aux])


def with_mean(obs: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """``obs`` with the pixel's weighted mean as ``_mean`` and its summed weight as ``_sum``."""
    pixel = Window.partitionBy(*keys)
    return obs.withColumn("_sum", F.sum(weight).over(pixel)).withColumn(
        "_mean", ratio(F.sum(F.col(weight) * F.col(value)).over(pixel), F.col("_sum"))
    )


def coadd_std(
    obs: DataFrame, *, keys: Sequence[str] = PIXEL, value: str = "value", weight: str = "weight", aux: Sequence[str] = (), exact: bool = False
) -> DataFrame:
    """Weighted population deviation of each pixel: ``keys, data, weight``, and that of each ``aux`` about its own mean.

    ``exact`` takes integer columns, whose sums of squares are exact: one aggregation, with no window. Deviations are 0 where the weights don't
    sum to more than 0."""
    w = F.col(weight)
    if exact:
        names = [value, *aux]
        sums = obs.groupBy(*keys).agg(
            F.sum(w).alias("_w"),
            *[F.sum(w * F.col(c)).alias(f"_1{c}") for c in names], *[F.sum(w * F.col(c) * F.col(c)).alias(f"_2{c}") for c in names],
        )

        def spread(c: str) -> Column:
            mean = ratio(F.col(f"_1{c}"), F.col("_w"))
            return F.when(F.col("_w") > 0, F.sqrt(F.greatest(ratio(F.col(f"_2{c}"), F.col("_w")) - mean * mean, F.lit(0.0)))).otherwise(0.0)

        return sums.select(*keys, spread(value).alias("data"), F.col("_w").alias("weight"), *[spread(a).alias(a) for a in aux])
    near = with_mean(obs, keys, value, weight)
    pixel = Window.partitionBy(*keys)
    for a in aux:
        near = near.withColumn(f"_m{a}", ratio(F.sum(w * F.col(a)).over(pixel), F.col("_sum")))
    sums = near.groupBy(*keys).agg(
        F.sum(w * (F.col(value) - F.col("_mean")) ** 2).alias("_v"), F.sum(w).alias("_w"),
        *[F.sum(w * (F.col(a) - F.col(f"_m{a}")) ** 2).alias(f"_v{a}") for a in aux],
    )

    def root(c: str) -> Column:
        return F.when(F.col("_w") > 0, F.sqrt(ratio(F.col(c), F.col("_w")))).otherwise(0.0)

    return sums.select(*keys, root("_v").alias("data"), F.col("_w").alias("weight"), *[root(f"_v{a}").alias(a) for a in aux])


def sigma_clipped(obs: DataFrame, sigma: float, *, keys: Sequence[str] = PIXEL, value: str = "value", weight: str = "weight", exact: bool = False) -> DataFrame:
    """``obs`` with ``kept``: within ``sigma`` deviations of the pixel's mean, inclusive."""
    w, v, pixel = F.col(weight), F.col(value), Window.partitionBy(*keys)
    near = with_mean(obs, keys, value, weight)
    if exact:
        square = ratio(F.sum(w * v * v).over(pixel), F.col("_sum")) - F.col("_mean") * F.col("_mean")
        spread = F.sqrt(F.greatest(square, F.lit(0.0)))
    else:
        spread = F.sqrt(F.greatest(ratio(F.sum(w * (v - F.col("_mean")) ** 2).over(pixel), F.col("_sum")), F.lit(0.0)))
    near = near.withColumn("_std", F.when(F.col("_sum") > 0, spread).otherwise(0.0))
    return near.withColumn("kept", F.abs(v - F.col("_mean")) <= F.lit(float(sigma)) * F.col("_std")).drop("_sum", "_mean", "_std")


def coadd_sigma_clip(
    obs: DataFrame, sigma: float, *, keys: Sequence[str] = PIXEL, value: str = "value", weight: str = "weight", aux: Sequence[str] = (), exact: bool = False
) -> DataFrame:
    """Weighted mean of the observations within ``sigma`` deviations; a pixel with none left is 0 with weight 0."""
    kept = sigma_clipped(obs, sigma, keys=keys, value=value, weight=weight, exact=exact)
    zeroed = kept.withColumn(weight, F.when(F.col("kept"), F.col(weight)).otherwise(F.lit(0)))
    return coadd_mean(zeroed, keys=keys, value=value, weight=weight, aux=aux)


def coadd(obs: DataFrame, mode: str, *, sigma: float | None = None, **options) -> DataFrame:
    """One of the modes ``mean``, ``std``, ``sigma_clip`` (with ``sigma``) or ``cache``: the observations of weight other than 0."""
    if mode == "mean":
        return coadd_mean(obs, **options)
    if mode == "std":
        return coadd_std(obs, **options)
    if mode == "sigma_clip":
        if sigma is None or sigma <= 0:
            raise ValueError("sigma_clip needs a sigma over 0")
        return coadd_sigma_clip(obs, sigma, **options)
    if mode == "cache":
        return obs.where(F.col(options.get("weight", "weight")) != 0)
    raise ValueError(f"mode {mode!r} is none of mean, std, sigma_clip, cache")


def wavelength_moments(obs: DataFrame, *, keys: Sequence[str] = PIXEL, weight: str = "weight", centre: str = "bc", width: str = "bw") -> DataFrame:
    """Mean and deviation of the mixture of uniform bands that each pixel was observed in: ``keys, wav_mean, wav_std, weight``.

    Rows with weight 0 or less don't count; what isn't finite is 0."""
    w = F.col(weight) * F.col(width)
    sums = obs.where(F.col(weight) > 0).groupBy(*keys).agg(
        F.sum(w).alias("_w"), F.sum(w * F.col(centre)).alias("_c"),
        F.sum(w * (F.col(width) * F.col(width) / 12.0 + F.col(centre) * F.col(centre))).alias("_q"),
    )
    mean = ratio(F.col("_c"), F.col("_w"))
    square = F.greatest(ratio(F.col("_q"), F.col("_w")) - mean * mean, F.lit(0.0))
    return sums.select(*keys, F.nanvl(mean, F.lit(0.0)).alias("wav_mean"), F.nanvl(F.sqrt(square), F.lit(0.0)).alias("wav_std"), F.col("_w").alias("weight"))


def bright_cut(obs: DataFrame, percentile: float, *, by: Sequence[str] = ("frame",), value: str = "value", weight: str = "weight", drop: str = "value") -> DataFrame:
    """Values above their frame's percentile become NaN (``drop="value"``) or get weight 0 (``drop="weight"``). Exact, linear between ranks; a
    frame's values must fit one task."""
    cut = obs.where(~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.percentile(value, percentile).alias("_cut"))
    high = F.coalesce(F.col(value) > F.col("_cut"), F.lit(False))
    joined = obs.join(cut, list(by), "left")
    if drop == "value":
        return joined.withColumn(value, F.when(high, F.lit(float("nan"))).otherwise(F.col(value).cast("double"))).drop("_cut")
    return joined.withColumn(weight, F.when(high, F.lit(0)).otherwise(F.col(weight))).drop("_cut")


def normalized(df: DataFrame, column: str) -> DataFrame:
    """``column`` divided by its maximum, if that is over 0."""
    top = df.agg(F.max(column).alias("_top"))  # one row
    return df.join(F.broadcast(top)).withColumn(column, F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(F.col(column).cast("double"))).drop("_top")
