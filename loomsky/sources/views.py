"""The data model's tables as views of the star schema: the same definitions for Spark and, as SQL, for the comparison.

Quantities that the inputs hold as decimals are taken as integers (cents, hundredths), so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: cells in a row of the raster, of chunks of an observation
WIDTH, CHUNKS = 50, 7

OBS_SQL = f"""obs AS (
  SELECT l_suppkey AS frame, l_partkey // {WIDTH} AS ref_y, l_partkey % {WIDTH} AS ref_x, l_partkey AS pix,
         CAST(l_linenumber - 1 AS BIGINT) AS chunk, CAST(round(l_extendedprice * 100) AS BIGINT) AS v,
         CAST(l_quantity AS BIGINT) AS w, CAST(round(l_discount * 100) AS BIGINT) AS dq, CAST(round(l_tax * 100) AS BIGINT) AS tax,
         (l_partkey % {WIDTH}) * 100 + CAST(round(l_tax * 100) AS BIGINT) * 10 AS map_x,
         (l_partkey // {WIDTH}) * 100 + CAST(round(l_discount * 100) AS BIGINT) * 5 AS map_y,
         l_orderkey AS ord, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag
  FROM lineitem)"""

GRID_SQL = f"""grid AS (
  SELECT p_partkey // {WIDTH} AS det_y, p_partkey % {WIDTH} AS det_x, p_partkey AS cell, CAST(p_size AS BIGINT) AS chunk,
         CAST(round(p_retailprice * 100) AS BIGINT) AS raster
  FROM part)"""

FRAMES_SQL = "frames AS (SELECT s_suppkey AS frame, CAST(round(s_acctbal * 100) AS BIGINT) AS bias FROM supplier)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each observed pixel; coordinates ``map_y, map_x`` in hundredths of a cell."""
    t = table(spark, sf_dir, "lineitem")
    y, x = F.expr(f"l_partkey div {WIDTH}"), F.expr(f"l_partkey % {WIDTH}")
    return t.select(
        F.col("l_suppkey").alias("frame"), y.alias("ref_y"), x.alias("ref_x"), F.col("l_partkey").alias("pix"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("chunk"), _hundredths("l_extendedprice").alias("v"),
        F.col("l_quantity").cast("bigint").alias("w"), _hundredths("l_discount").alias("dq"), _hundredths("l_tax").alias("tax"),
        (x * 100 + _hundredths("l_tax") * 10).alias("map_x"), (y * 100 + _hundredths("l_discount") * 5).alias("map_y"),
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_returnflag").alias("flag"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each raster cell."""
    t = table(spark, sf_dir, "part")
    return t.select(
        F.expr(f"p_partkey div {WIDTH}").alias("det_y"), F.expr(f"p_partkey % {WIDTH}").alias("det_x"), F.col("p_partkey").alias("cell"),
        F.col("p_size").cast("bigint").alias("chunk"), _hundredths("p_retailprice").alias("raster"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), _hundredths("s_acctbal").alias("bias"))
