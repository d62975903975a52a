"""From observations to weighted, offset-corrected ones: the steps every pass shares, in the order that counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masks
from . import tiles

Hook = Callable[[DataFrame], DataFrame]
#: from a chunk map and ``frame, chunk, value`` to a surface, ``frame, det_y, det_x, raster``
SurfaceHook = Callable[[DataFrame | None, DataFrame | None], DataFrame]


def prepare(
    obs: DataFrame,
    *,
    ignore_bits: Iterable[int | str] = (),
    bit_names: dict[str, int] | None = None,
    offsets: DataFrame | None = None,
    offset_surface: DataFrame | SurfaceHook | None = None,
    chunk_map: DataFrame | None = None,
    grid_weight: DataFrame | None = None,
    oversample: int = 1,
    inverse_square: str | None = None,
    preprocess: Hook | None = None,
    postprocess: Hook | None = None,
    keys: Sequence[str] = ("frame", "ref_y", "ref_x"),
) -> DataFrame:
    """``obs`` with ``value`` less its offset, and ``weight``.

    Weight begins at 1. ``preprocess`` takes and gives a DataFrame with ``value`` and ``weight``. Flagged pixels get weight 0. The offset is, of a
    ``offset_surface`` (frame, det_y, det_x, raster), what bilinear interpolation gives, or of ``offsets`` (frame, chunk, value) that of ``obs``'s chunk; where
    there is none it is 0. A function given as ``offset_surface`` makes one of ``chunk_map`` and ``offsets``. ``grid_weight`` (det_y, det_x, weight) is interpolated at ``oversample`` times the detector's places and multiplied, as is 1 / x ** 2 of the
    column ``inverse_square``. After ``postprocess``, NaN values become 0 with weight 0."""
    df = obs if "weight" in obs.columns else obs.withColumn("weight", F.lit(1.0))
    if preprocess:
        df = preprocess(df)
    if "dq" in df.columns:
        df = df.withColumn("weight", F.when(masks.is_flagged(F.col("dq"), ignore_bits, bit_names), 0.0).otherwise(F.col("weight")))
    df = df.where("weight <> 0")  # before any join
    if oversample != 1:
        df = df.withColumns({"_gy": F.col("map_y") * oversample, "_gx": F.col("map_x") * oversample})
    y, x = ("_gy", "_gx") if oversample != 1 else ("map_y", "map_x")
    if callable(offset_surface):
        offset_surface = offset_surface(chunk_map, offsets)
    if offset_surface is not None:
        df = tiles.interpolated(df, offset_surface, name="_offset", by=["frame"], y=y, x=x)
    elif offsets is not None:
        df = df.join(offsets.select("frame", "chunk", F.col("value").alias("_offset")), ["frame", "chunk"], "left")
    if "_offset" in df.columns:
        df = df.withColumn("value", F.col("value") - F.coalesce("_offset", F.lit(0.0))).drop("_offset")
    if grid_weight is not None:
        df = tiles.interpolated(df, grid_weight, "weight", name="_w", y=y, x=x)
        df = df.withColumn("weight", F.col("weight") * F.col("_w")).drop("_w")
    if inverse_square:
        df = df.withColumn("weight", F.col("weight") * masks.inverse_square_weight(F.col(inverse_square)))
    if postprocess:
        df = postprocess(df)
    return masks.nan_to_zero(df).drop("_gy", "_gx")


def chunk_shares(obs: DataFrame, chunk_map: DataFrame, *, oversample: int = 1) -> DataFrame:
    """``obs``, a row for each chunk that shares in a pixel, with ``chunk, share``."""
    scaled = obs.withColumns({"_gy": F.col("map_y") * oversample, "_gx": F.col("map_x") * oversample})
    return tiles.shares(scaled, chunk_map, y="_gy", x="_gx").drop("_gy", "_gx")
