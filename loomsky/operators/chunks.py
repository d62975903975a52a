"""Chunk maps, their adjacency, and window-shaped operators on rasters and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def neighbours(grid: DataFrame, along: str, across: str, *, chunk: str = "chunk") -> DataFrame:
    """``a, b``: chunks of cells next to each other in the direction of ``along``; a line of the raster is one window."""
    line = Window.partitionBy(across).orderBy(along)
    beside = grid.select(F.col(chunk).alias("a"), F.lead(chunk).over(line).alias("b"), F.lead(along).over(line).alias("_to"), F.col(along).alias("_at"))
    return beside.where("_to = _at + 1").select("a", "b")


def _pairs(found: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct ``chunk_i < chunk_j``; ``strict`` takes only pairs met in that order."""
    if strict:
        found = found.where("a < b")
    return found.select(F.least("a", "b").alias("chunk_i"), F.greatest("a", "b").alias("chunk_j")).where("chunk_i < chunk_j").distinct()


def chunk_adjacency(grid: DataFrame, *, y: str = "det_y", x: str = "det_x", strict: bool = False) -> DataFrame:
    """Chunks that touch across or down, each pair once; chunk -1 touches none. ``strict`` keeps only pairs whose lesser chunk lies left of or
    above the other somewhere."""
    found = neighbours(grid, x, y).union(neighbours(grid, y, x)).where("a <> -1 and b <> -1")
    return _pairs(found, strict)


def column_adjacency(grid: DataFrame, columns: int, *, y: str = "det_y", x: str = "det_x") -> DataFrame:
    """Chunks of one subchannel (chunk div ``columns``) that touch across."""
    return _pairs(neighbours(grid, x, y).where(f"a >= 0 and b >= 0 and a div {columns} = b div {columns}"))


def subchannel_adjacency(grid: DataFrame, columns: int, *, y: str = "det_y", x: str = "det_x") -> DataFrame:
    """Chunks of one strip (chunk % ``columns``) in neighbouring subchannels that touch down."""
    return _pairs(neighbours(grid, y, x).where(f"a >= 0 and b >= 0 and abs(a div {columns} - b div {columns}) = 1 and a % {columns} = b % {columns}"))


def arc_chunks(grid: DataFrame, xc: float, yc: float, radii: Sequence[float], *, y: str = "det_y", x: str = "det_x") -> DataFrame:
    """``grid`` with ``chunk``: how many of ``radii`` (a table of the instrument, some hundreds) are less than the cell's distance to the centre."""
    away = F.sqrt((F.col(x) - F.lit(float(xc))) ** 2 + (F.col(y) - F.lit(float(yc))) ** 2)
    edges = F.array(*[F.lit(float(r)) for r in sorted(radii)])
    return grid.withColumn("chunk", F.size(F.filter(edges, lambda r: r < away)).cast("bigint"))


def refined_edges(edges: DataFrame, k: int, *, value: str = "edge") -> DataFrame:
    """``value`` in ``k`` equal steps between each edge and the next, and the last edge."""
    by_value = Window.orderBy(value)  # the edges of an instrument's channels
    steps = edges.select(F.col(value).alias("a"), F.lead(value).over(by_value).alias("b"))
    inner = steps.where("b is not null").select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    return inner.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / float(k)).alias(value)).union(steps.where("b is null").select(F.col("a").cast("double")))


def fiducial_chunks(grid: DataFrame, xc: float, yc: float, radii: Sequence[float], n_channels: int = 17, n_sub: int = 10, **options) -> DataFrame:
    """Arc chunks of channel edges refined to ``n_sub`` subchannels each: ids 0 to n_channels * n_sub + 1."""
    if n_channels % 17:
        raise ValueError("the channels must be a multiple of 17")
    k = n_sub * n_channels // 17
    fine = [a + (b - a) * i / k for a, b in zip(radii, radii[1:]) for i in range(k)] + [radii[-1]]
    return arc_chunks(grid, xc, yc, fine, **options)


def strip_chunks(grid: DataFrame, columns: int, width: int, *, x: str = "det_x", chunk: str = "chunk") -> DataFrame:
    """``grid`` with its chunks cut into ``columns`` strips: chunk * columns + strip. Strip k begins at the whole part of k * width / columns."""
    starts = F.array(*[F.lit(k * width // columns) for k in range(1, columns)]) if columns > 1 else F.array().cast("array<int>")
    strip = F.size(F.filter(starts, lambda s: s <= F.col(x)))
    return grid.withColumn(chunk, F.col(chunk) * columns + strip)


def vertical_distance(grid: DataFrame, *, y: str = "det_y", x: str = "det_x", value: str = "valid") -> DataFrame:
    """``grid`` with ``distance``: cells to the nearest 0 above or below in the column; the first and the last cell count as one."""
    down = Window.partitionBy(x).orderBy(y)
    zero = F.col(value) == 0
    marked = grid.withColumns({"_first": F.min(y).over(Window.partitionBy(x)), "_last": F.max(y).over(Window.partitionBy(x))})
    above = F.max(F.when(zero | (F.col(y) == F.col("_first")), F.col(y))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.min(F.when(zero | (F.col(y) == F.col("_last")), F.col(y))).over(down.rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn("distance", F.least(F.col(y) - above, below - F.col(y))).drop("_first", "_last")


def run_bins(series: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal ``value``: ``by, start, end, centre, value``, places from 0 on, ``end`` exclusive, edges half a place before. The first and the
    last run, whose ends the series cuts off, are left out."""
    line = Window.partitionBy(*by).orderBy(*order)
    placed = series.withColumns({"_at": F.row_number().over(line).cast("bigint") - 1, "_before": F.lag(value).over(line)})
    starts = placed.where("_at = 0 or not (_before <=> {})".format(value)).select(*by, F.col("_at").alias("start"), value)
    heads = Window.partitionBy(*by).orderBy("start")
    runs = starts.withColumns({"end": F.lead("start").over(heads), "_n": F.row_number().over(heads)}).where("end is not null and _n > 1")
    return runs.select(*by, "start", "end", (F.col("start") - 0.5).alias("edge"), ((F.col("start") + F.col("end") - 1) / 2).alias("centre"), value)


def cumulative(series: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, name: str = "cumulative") -> DataFrame:
    """``series`` with the running sum of ``amount`` up to and with each row; what lies before the first is 0."""
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(name, F.sum(amount).over(line))


def cumulative2d(raster: DataFrame, amount: Column, *, y: str = "det_y", x: str = "det_x", name: str = "volume", by: Sequence[str] = ()) -> DataFrame:
    """``raster`` with the sum of ``amount`` over all cells above and left of each, itself included. An axis with one cell is not summed along."""
    across = Window.partitionBy(*by, y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    return raster.withColumn("_row", F.sum(amount).over(across)).withColumn(name, F.sum("_row").over(down)).drop("_row")


def chunk_edges(shape: DataFrame, chunk_ny: int, chunk_nx: int) -> DataFrame:
    """``axis, edge``: where chunks of ``chunk_ny`` by ``chunk_nx`` cells begin on a detector of ``shape`` (``ny, nx``), and its end where they fill it."""
    def along(axis: str, step: int) -> DataFrame:
        return shape.select(F.lit(axis).alias("axis"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n{axis}"), F.lit(step).cast("bigint"))).alias("edge"))

    return along("y", chunk_ny).unionByName(along("x", chunk_nx))
