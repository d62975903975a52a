"""Exact order statistics of groups of any size, by refining histograms: no task holds a group.

Each rank asked for is known to lie between two values of its group. A round counts the group's values there in ``BINS`` bins, finds the bin that
has the rank, and goes on between that bin's least and greatest value, until these are one. What is shuffled is a row for each bin and task; a value that a
third of a group shares ends the search as soon as it has a bin of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Store

BINS = 1024


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str], also: Column | None = None) -> DataFrame:
    """``left`` joined with the rows of ``right`` of its group; null is a group as others."""
    own = right.select(*[F.col(b).alias(f"_{b}") for b in by], *[c for c in right.columns if c not in by])
    same = F.lit(True) if also is None else also
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_{b}"))
    return left.join(own, same).drop(*[f"_{b}" for b in by])


def ranked(df: DataFrame, ranks: DataFrame, by: Sequence[str], value: Column, *, most_rounds: int = 64) -> DataFrame:
    """``by, rank, value``: the value with each of ``ranks`` (``by, rank``; from 0) among its group's values that are neither null nor NaN."""
    store = Store(df.sparkSession)
    kept = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = kept.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = _beside(ranks.select(*by, "rank").distinct(), ends, by).withColumn("below", F.lit(0).cast("bigint"))
    state = store.keep(state.select(*by, "rank", "lo", "hi", "below"), "state")
    key = [*by, "rank"]
    done = None
    for _ in range(most_rounds):
        settled = state.where("lo = hi").select(*key, F.col("lo").alias("value"))
        done = store.keep(settled if done is None else done.unionByName(settled))
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            store.drop("state")
            return done
        # halves, for a difference that overflows; a place among the bins, the last for the greatest value
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        binned = _beside(kept, open_, by, F.col("_v").between(F.col("lo"), F.col("hi"))).select(*by, "rank", "below", "_v", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
        bins = binned.groupBy(*key, "below", "bin").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))  # a row for each bin
        found = bins.withColumn("upto", upto).where("rank < upto and rank >= upto - n")
        state = store.keep(found.select(*key, "lo", "hi", (F.col("upto") - F.col("n")).alias("below")), "state")
    raise RuntimeError(f"order statistics did not settle in {most_rounds} rounds")


def quantiles(df: DataFrame, by: Sequence[str], value: str | Column, shares: Sequence[float]) -> DataFrame:
    """``by, share, value``: exact quantiles of each group, between two values in proportion, as ``percentile`` gives them. Null and NaN values don't count; a group
    without any others has no rows."""
    v = F.col(value) if isinstance(value, str) else value
    n = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*by).agg(F.count("*").alias("n")).where("n > 0")
    at = n.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_at", F.col("share") * (F.col("n") - 1))
    at = Store(df.sparkSession).keep(at.withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")}))
    ranks = at.select(*by, F.explode(F.array("_low", "_high")).alias("rank"))
    values = ranked(df, ranks, by, v)
    for name in ("low", "high"):
        own = values.select(*by, F.col("rank").alias("_rank"), F.col("value").alias(name))
        at = _beside(at, own, by, F.col(f"_{name}") == F.col("_rank")).drop("_rank")
    between = F.col("low") + (F.col("_at") - F.col("_low")) * (F.col("high") - F.col("low"))
    return at.select(*by, "share", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value"))
