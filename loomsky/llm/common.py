"""Shared folder, stored intermediates, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine, as in tests, may name none, and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = _own_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and outlives executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``df``, a stored table, marked for broadcast where its rows, counted now, take less than ``limit`` bytes in memory; beyond that it is
    joined by a shuffle."""
    wide = [8 * F.size(f.name) for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    wide += [F.octet_length(f.name) for f in df.schema.fields if isinstance(f.dataType, StringType)]
    rows, more = df.agg(F.count("*"), sum((F.coalesce(F.sum(w), F.lit(0)) for w in wide), F.lit(0))).first()
    return F.broadcast(df) if rows * (24 + 16 * len(df.columns)) + more <= limit else df


def gathered(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, a stored table of a few numbers a row, in one partition where it has up to ``rows`` rows, counted now: joins and groups of so few
    aren't worth shuffles. Beyond that, as it is."""
    return df.coalesce(1) if df.count() <= rows else df


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) of each of ``pairs`` of columns, where they differ."""
    each = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])
    return df.select(F.explode(each).alias("e")).select("e.u", "e.v").where("u <> v")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), the smallest node of each.

    Alternates large-star and small-star steps (Kiveris et al., 2014), in which every node sends its
    neighbours to the smallest one it knows, until the edges stop changing. Minima are aggregated before
    the shuffle, so a node with very many neighbours costs no more than its edges.
    Self-loops and null ends are ignored; no edges give no rows.
    """
    cur = stored(_pairs(edges, ("a", "b")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        cur = gathered(cur)
        both = _pairs(cur, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = stored(_pairs(large.join(low, "u"), ("v", "m"), ("u", "m")).distinct())
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    every = F.explode(F.array(F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), "v"))).alias("e")
    return gathered(cur).select(every).groupBy(F.col("e.node").alias("node")).agg(F.min("e.v").alias("component"))
