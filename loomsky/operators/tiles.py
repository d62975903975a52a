"""Rasters as tiles with a halo: what a target needs of a raster lies in one row.

A tile has the cells of a square of ``SIZE`` by ``SIZE`` and those one row below and one column right of it, as arrays. The four cells about a place
are then in one tile, and bilinear interpolation is a join on the tile and a projection: targets are neither multiplied nor
grouped again. A raster of counted size is broadcast, so that targets aren't shuffled at all; beyond that they are, once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 32
#: cells of a raster up to which its tiles are broadcast: some 8 bytes for each value of each
SMALL = 1 << 24


def tiled(raster: DataFrame, values: Sequence[str], *, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``by, tile_y, tile_x`` and an array of each of ``values``, row by row; null where the raster (``det_y, det_x``) has no cell. Of rows
    that share a cell, the greatest value counts."""
    side = size + 1
    y, x = F.col("det_y").cast("bigint"), F.col("det_x").cast("bigint")
    ty, tx = F.floor(y / size), F.floor(x / size)

    def home(a: int, b: int) -> Column:
        """The cell's place in the tile ``a`` before its own in y and ``b`` in x."""
        at = (y - (ty - a) * size) * side + (x - (tx - b) * size)
        return F.struct((ty - a).alias("tile_y"), (tx - b).alias("tile_x"), at.alias("at"))

    top, left = y == ty * size, x == tx * size
    homes = F.array_compact(F.array(home(0, 0), F.when(top, home(1, 0)), F.when(left, home(0, 1)), F.when(top & left, home(1, 1))))
    tile = [*by, "tile_y", "tile_x"]
    cells = raster.select(*by, F.explode(homes).alias("h"), *values).select(*by, "h.*", *values)
    cells = cells.groupBy(*tile, "at").agg(*[F.max(v).alias(v) for v in values])
    every = cells.select(*tile).distinct().withColumn("at", F.explode(F.expr(f"sequence(0L, {side * side - 1}L)")))
    dense = every.join(cells, [*tile, "at"], "left").groupBy(*tile).agg(F.sort_array(F.collect_list(F.struct("at", *values))).alias("c"))
    return dense.select(*tile, *[F.col("c")[v].alias(v) for v in values])


@dataclass
class Corners:
    """Targets beside the tile that each needs: ``rows``, the weights of its four corners and the cells there."""

    rows: DataFrame
    weights: list[Column]
    places: list[Column]

    def cells(self, value: str) -> list[Column]:
        return [F.get(F.col(f"_tile_{value}"), p) for p in self.places]


def corners(
    targets: DataFrame, raster: DataFrame, values: Sequence[str], *, by: Sequence[str] = (), y: str = "map_y", x: str = "map_x", scale: int = 1, size: int = SIZE
) -> Corners:
    """Each of ``targets`` with its tile of ``raster``. ``scale`` over 1 takes coordinates as integers in parts of a cell; the weights then are integers
    that sum to scale ** 2. With a null or NaN coordinate weights and cells are null."""
    known = ~F.isnan(F.col(y).cast("double")) & ~F.isnan(F.col(x).cast("double"))
    placed = targets.withColumns({"_y0": F.when(known, F.floor(F.col(y) / scale)), "_x0": F.when(known, F.floor(F.col(x) / scale))})
    placed = placed.withColumns({"_ty": F.floor(F.col("_y0") / size), "_tx": F.floor(F.col("_x0") / size)})
    tiles = tiled(raster, values, by=by, size=size).select(
        *[F.col(b).alias(f"_by_{b}") for b in by], F.col("tile_y").alias("_tile_y"), F.col("tile_x").alias("_tile_x"), *[F.col(v).alias(f"_tile_{v}") for v in values]
    )
    same = (F.col("_ty") == F.col("_tile_y")) & (F.col("_tx") == F.col("_tile_x"))
    for b in by:
        same &= F.col(b) == F.col(f"_by_{b}")
    if not by and raster.count() <= SMALL:
        tiles = F.broadcast(tiles)
    fy, fx = F.col(y) - F.col("_y0") * scale, F.col(x) - F.col("_x0") * scale
    first = (F.col("_y0") - F.col("_ty") * size) * (size + 1) + F.col("_x0") - F.col("_tx") * size
    places = [(first + k).cast("int") for k in (0, 1, size + 1, size + 2)]
    return Corners(placed.join(tiles, same, "left"), [(scale - fy) * (scale - fx), (scale - fy) * fx, fy * (scale - fx), fy * fx], places)


def interpolated(
    targets: DataFrame, raster: DataFrame, value: str = "raster", *, name: str | None = None, by: Sequence[str] = (), y: str = "map_y", x: str = "map_x", scale: int = 1
) -> DataFrame:
    """``targets`` with the raster's ``value`` at each, as ``name``. Corners outside the raster are left out and the others aren't
    scaled up; a target without any, or without coordinates, is 0."""
    met = corners(targets, raster, [value], by=by, y=y, x=x, scale=scale)
    parts = [F.when(w != 0, w * c) for w, c in zip(met.weights, met.cells(value))]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))) / (scale * scale)
    return met.rows.select(*targets.columns, total.alias(name or value))


def shares(targets: DataFrame, chunk_map: DataFrame, *, y: str = "map_y", x: str = "map_x", scale: int = 1) -> DataFrame:
    """``targets``, a row for each chunk (0 and up) that has a bilinear weight over 0 there, with ``chunk, share``."""
    met = corners(targets, chunk_map, ["chunk"], y=y, x=x, scale=scale)
    ids = [F.when((w > 0) & (c >= 0), c) for w, c in zip(met.weights, met.cells("chunk"))]
    each = []
    for k, c in enumerate(ids):
        earlier = F.lit(False)
        for other in ids[:k]:
            earlier |= F.coalesce(other == c, F.lit(False))
        total = sum((F.when(other == c, w).otherwise(0) for other, w in zip(ids[k + 1 :], met.weights[k + 1 :])), met.weights[k])
        each.append(F.when(c.isNotNull() & ~earlier, F.struct(c.alias("chunk"), (total / (scale * scale)).alias("share"))))
    rows = met.rows.select(*[t for t in targets.columns if t != "chunk"], F.explode(F.array(*each)).alias("_e")).where("_e is not null")
    return rows.select("*", "_e.chunk", "_e.share").drop("_e")


def heavy_bits(words: Sequence[Column], weights: Sequence[Column], threshold: float) -> Column:
    """The bits that are set in ``words`` of a weight over ``threshold`` together: a bit that just some words have is in their conjunction, so these are the
    disjunction over the sets of words that weigh enough."""
    found = F.lit(0).cast("bigint")
    for chosen in range(1, 1 << len(words)):
        some = [k for k in range(len(words)) if chosen >> k & 1]
        both, weight = words[some[0]], weights[some[0]]
        for k in some[1:]:
            both, weight = both.bitwiseAND(words[k]), weight + weights[k]
        found = found.bitwiseOR(F.when(weight > threshold, both).otherwise(F.lit(0).cast("bigint")))
    return found


def mask(targets: DataFrame, raster: DataFrame, dq: str = "dq", *, threshold: float = 0.01, y: str = "map_y", x: str = "map_x", scale: int = 1) -> DataFrame:
    """``targets`` with ``dq``: a bit is set where the bilinear weight of the cells that have it is over ``threshold``."""
    met = corners(targets, raster, [dq], y=y, x=x, scale=scale)
    words = [F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF)) for c in met.cells(dq)]
    weights = [F.coalesce(w, F.lit(0)) for w in met.weights]
    found = heavy_bits(words, weights, threshold * scale * scale)
    return met.rows.select(*[t for t in targets.columns if t != dq], found.alias(dq))
