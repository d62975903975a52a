"""A cache of observations in the order of their place on the sky, with a list of its files' boxes, so that a part of the sky reads the files that meet it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Frame, from_plane, separation

#: bits of a tile's coordinates that its place in the order is made of
_BITS = 20


def tile_order(y: Column, x: Column) -> Column:
    """The place of a tile on Morton's curve: the bits of its coordinates in turn, so that tiles near each other in the order lie together on the sky. Of
    coordinates from 0 to 2 ** 20 - 1; those beyond share places with others, which costs files but no rows."""
    out = F.lit(0).cast("bigint")
    for k in range(_BITS):
        for v, at in ((y, 2 * k + 1), (x, 2 * k)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v.cast("bigint"), k).bitwiseAND(F.lit(1)), at))
    return out


def write_tiled(obs: DataFrame, path: str, *, files: int, tile: int = 256, weight: str = "weight") -> DataFrame:
    """Observations of weight other than 0, read back, as about ``files`` files that are each of one range of the sky. A tile of any number of observations
    is split among files. ``path/boxes`` holds each file's name, rows and first and last places. Observations without a place or a weight are left out."""
    order = tile_order(*(F.floor(F.col(v) / tile) for v in ("ref_y", "ref_x")))
    placed = obs.where((F.col(weight) != 0) & F.col("ref_y").isNotNull() & F.col("ref_x").isNotNull()).withColumn("_order", order)
    ranged = placed.repartitionByRange(files, "_order", "ref_y", "ref_x", *[c for c in ("frame",) if c in obs.columns])
    ranged.sortWithinPartitions("_order", "ref_y", "ref_x").drop("_order").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    rows = obs.sparkSession.read.schema(obs.schema).parquet(f"{path}/rows")
    ends = [f(v).alias(f"{v}_{n}") for v in ("ref_y", "ref_x") for n, f in (("min", F.min), ("max", F.max))]
    boxes = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), *ends)
    boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")  # a row for each file
    return rows


def read_box(spark: SparkSession, path: str, y_min: int, y_max: int, x_min: int, x_max: int) -> DataFrame:
    """The cache's observations with places from the first to the last, both inclusive. Files whose boxes lie elsewhere aren't opened."""
    boxes = spark.read.parquet(f"{path}/boxes")
    met = boxes.where((F.col("ref_y_max") >= y_min) & (F.col("ref_y_min") <= y_max) & (F.col("ref_x_max") >= x_min) & (F.col("ref_x_min") <= x_max))
    names = [f"{path}/rows/{r.file}" for r in met.select("file").collect()]  # files, not rows
    schema = spark.read.parquet(f"{path}/rows").schema
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*names).where(F.col("ref_y").between(y_min, y_max) & F.col("ref_x").between(x_min, x_max))


def cone_box(spark: SparkSession, frame: Frame, ra: float, dec: float, radius: float, *, points: int = 64) -> tuple[int, int, int, int]:
    """The box (y_min, y_max, x_min, x_max) of pixels of ``frame`` that a cone of up to 45 degrees may hold, by points about it, and some room for the arcs between them."""
    if not 0 <= radius <= 45:
        raise ValueError("a cone's radius is from 0 to 45 degrees")
    turn = F.col("id") * (2 * math.pi / points)
    size = math.degrees(math.tan(math.radians(radius))) / math.cos(math.pi / points)
    x, y = frame.pixel(*from_plane(F.cos(turn) * size, F.sin(turn) * size, ra, dec))
    y0, y1, x0, x1, n = spark.range(points).select(y.alias("y"), x.alias("x")).agg(F.min("y"), F.max("y"), F.min("x"), F.max("x"), F.count("x")).first()
    if n < points:
        raise ValueError("the cone reaches beyond the frame's half of the sky")
    return math.floor(y0), math.ceil(y1), math.floor(x0), math.ceil(x1)


def read_cone(spark: SparkSession, path: str, frame: Frame, ra: float, dec: float, radius: float) -> DataFrame:
    """The cache's observations strictly within ``radius`` degrees, from the files that meet the cone's box."""
    found = read_box(spark, path, *cone_box(spark, frame, ra, dec, radius))
    at = frame.sky(F.col("ref_x").cast("double"), F.col("ref_y").cast("double"))
    return found.where(separation(*at, F.lit(float(ra)), F.lit(float(dec))) < radius)
