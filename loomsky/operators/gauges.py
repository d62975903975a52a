"""Directions that a system leaves open: in each connected group of frames and sky pixels, a constant can move from the sky to the offsets.

Columns are nodes, and a data row joins its sky column with its offset columns. Where frames share no pixel, directly or by others, the system falls apart
into groups, each with an open constant of its own. ``groups`` finds them and ``centred`` takes the one solution whose offsets have the mean 0
in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def links(a: DataFrame, n_sky: int) -> DataFrame:
    """``sky, offset``: pairs of columns that meet in a row of ``a`` (``row, col, val``) with values other than 0."""
    met = a.where("val <> 0")
    sky = met.where(F.col("col") < n_sky).select("row", F.col("col").alias("sky"))
    offset = met.where(F.col("col") >= n_sky).select("row", F.col("col").alias("offset"))
    return sky.join(offset, "row").select("sky", "offset").distinct()  # an observation has one sky column


def groups(pairs: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``col, gauge``: the least column of each connected group of ``pairs`` (``sky, offset``).

    Each column takes the least label among its own and its neighbours', and then its label's own label, until nothing changes; so the distance
    that labels travel doubles. Least labels are aggregated before the shuffle: a pixel that every frame sees, or a frame that sees every pixel, is no
    hot key."""
    store = Store(pairs.sparkSession)
    both = store.keep(pairs.select(F.col("sky").alias("u"), F.col("offset").alias("v")).union(pairs.select("offset", "sky")), "edges")
    labels = store.keep(both.select(F.col("u").alias("col")).distinct().withColumn("gauge", F.col("col")), "labels")
    before = None
    for _ in range(most_rounds):
        near = both.join(labels, F.col("v") == F.col("col")).groupBy("u").agg(F.min("gauge").alias("near"))
        hooked = labels.join(near, F.col("col") == F.col("u")).select("col", F.least("gauge", "near").alias("gauge"))
        hooked = store.keep(hooked, "hooked")
        own = hooked.select(F.col("col").alias("at"), F.col("gauge").alias("further"))
        labels = store.keep(hooked.join(own, F.col("gauge") == F.col("at")).select("col", F.least("gauge", "further").alias("gauge")), "labels")
        now = labels.agg(F.sum(F.col("gauge").cast("decimal(38,0)"))).first()[0]
        if now == before:  # labels only fall
            store.drop("edges", "hooked")
            return labels
        before = now
    raise RuntimeError(f"groups did not settle in {most_rounds} rounds")


def centred(x: DataFrame, found: DataFrame, n_sky: int) -> DataFrame:
    """A solution ``col, value`` whose offsets have the mean 0 in each group of ``found`` (``col, gauge``), the sky taking what they give. What the data rows
    say stays as it is. Columns of no group stay too."""
    placed = x.join(found, "col", "left")
    means = placed.where((F.col("col") >= n_sky) & F.col("gauge").isNotNull()).groupBy("gauge").agg(F.avg("value").alias("mean"))
    given = F.coalesce("mean", F.lit(0.0)) * F.when(F.col("col") < n_sky, 1.0).otherwise(-1.0)
    return placed.join(means, "gauge", "left").select("col", (F.col("value") + given).alias("value"))
