"""Bilinear resampling, chunk contributions, binning and footprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles


def bilinear(targets: DataFrame, raster: DataFrame, keys: Sequence[str], *, value: str = "raster", y: str = "map_y", x: str = "map_x", scale: int = 1) -> DataFrame:
    """``keys, value``: the raster (``det_y, det_x, value``) at each target, a row each."""
    return tiles.interpolated(targets.select(*keys, y, x), raster, value, y=y, x=x, scale=scale).select(*keys, value)


def chunk_contributions(targets: DataFrame, chunk_map: DataFrame, keys: Sequence[str], *, y: str = "map_y", x: str = "map_x", scale: int = 1) -> DataFrame:
    """``keys, chunk, share``: the bilinear weight of each chunk (0 and up) at each target, where it is over 0."""
    return tiles.shares(targets.select(*keys, y, x), chunk_map, y=y, x=x, scale=scale).select(*keys, "chunk", "share")


def resampled_mask(targets: DataFrame, raster: DataFrame, keys: Sequence[str], *, dq: str = "dq", threshold: float = 0.01, scale: int = 1, y: str = "map_y", x: str = "map_x") -> DataFrame:
    """``keys, dq``: a bit is set where the bilinear weight of cells that have it is over ``threshold``."""
    return tiles.mask(targets.select(*keys, y, x), raster, dq, threshold=threshold, y=y, x=x, scale=scale).select(*keys, dq)


def gather_chunks(grid: DataFrame, values: DataFrame, *, chunk: str = "chunk") -> DataFrame:
    """``grid`` with the value of each cell's chunk; cells of chunks without one are left out."""
    return grid.join(values, chunk)


def crop(obs: DataFrame, ny: int, nx: int, *, y: str = "ref_y", x: str = "ref_x") -> DataFrame:
    """Rows inside the reference frame."""
    return obs.where(F.col(y).between(0, ny - 1) & F.col(x).between(0, nx - 1))


def bounds(obs: DataFrame, by: Sequence[str], *, y: str = "ref_y", x: str = "ref_x") -> DataFrame:
    """``by, y_min, y_max, x_min, x_max`` of the rows; the greater ends are exclusive."""
    return obs.groupBy(*by).agg(
        F.min(y).alias("y_min"), (F.max(y) + 1).alias("y_max"), F.min(x).alias("x_min"), (F.max(x) + 1).alias("x_max")
    )


def bin2d(raster: DataFrame, k: int, reduce: Callable[[str], Column] = F.avg, *, y: str = "det_y", x: str = "det_x", value: str = "raster", by: Sequence[str] = ()) -> DataFrame:
    """Blocks of ``k`` by ``k`` cells reduced by ``reduce``; cells at the far edges form smaller blocks."""
    return raster.groupBy(*by, F.expr(f"{y} div {k}").alias(y), F.expr(f"{x} div {k}").alias(x)).agg(reduce(value).alias(value))


def bin_columns(matrix: DataFrame, width: int, k: int, *, merge: bool = True) -> DataFrame:
    """A matrix (``row, col, val``) whose columns are cells of a raster ``width`` wide, for the raster binned by ``k``."""
    small = -(-width // k)
    col = F.expr(f"(col div {width}) div {k}") * small + F.expr(f"(col % {width}) div {k}")
    out = matrix.select("row", col.alias("col"), (F.col("val") / (k * k)).alias("val"))
    return out.groupBy("row", "col").agg(F.sum("val").alias("val")) if merge else out


def footprint(obs: DataFrame, valid: Column, *, keys: Sequence[str] = ("ref_y", "ref_x"), offset: Column | None = None) -> DataFrame:
    """``keys, footprint``: how many valid observations each pixel has, or their summed ``offset``."""
    one = F.lit(1) if offset is None else offset
    return obs.groupBy(*keys).agg(F.sum(F.when(valid, one).otherwise(F.lit(0))).alias("footprint"))


def upscale2d(raster: DataFrame, ny: int, nx: int, new_ny: int, new_nx: int, *, value: str = "raster", by: Sequence[str] = ()) -> DataFrame:
    """A raster (``det_y, det_x, value``) of ``ny`` by ``nx`` cells at ``new_ny`` by ``new_nx``, bilinear, corners on corners. Cell y of the new
    raster lies at y (ny - 1) / (new_ny - 1)."""
    dy, dx = max(new_ny - 1, 1), max(new_nx - 1, 1)
    # Every old cell gives to the new cells whose corners include it: their places are whole parts of dy and dx.
    tall = F.explode(F.sequence(F.lit(0), F.lit(new_ny - 1)))
    wide = F.explode(F.sequence(F.lit(0), F.lit(new_nx - 1)))
    targets = raster.sparkSession.range(1).select(tall.alias("new_y")).select("new_y", wide.alias("new_x")).withColumns(
        {"map_y": F.col("new_y").cast("bigint") * (ny - 1), "map_x": F.col("new_x").cast("bigint") * (nx - 1)}
    )
    y0, x0 = F.expr(f"map_y div {dy}"), F.expr(f"map_x div {dx}")
    fy, fx = F.expr(f"map_y % {dy}"), F.expr(f"map_x % {dx}")
    four = F.array(*[
        F.struct((y0 + a).alias("det_y"), (x0 + b).alias("det_x"), ((fy if a else dy - fy) * (fx if b else dx - fx)).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ])
    spread = targets.select("new_y", "new_x", F.explode(F.filter(four, lambda c: c.w != 0)).alias("c")).select("new_y", "new_x", "c.*")
    met = raster.join(F.broadcast(spread), ["det_y", "det_x"])  # four rows for each cell of one new raster
    total = (F.sum(F.col("w") * F.col(value)) / float(dy * dx)).alias(value)
    return met.groupBy(*by, F.col("new_y").cast("bigint").alias("det_y"), F.col("new_x").cast("bigint").alias("det_x")).agg(total)
