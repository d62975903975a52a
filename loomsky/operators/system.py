"""The sparse least-squares system of a common sky and per-frame, per-chunk offsets, as long tables.

``A`` is ``row, col, val``, ``b`` is ``row, val``. Columns 0 to n_sky - 1 are sky pixels (ref_y * nx + ref_x), the rest are offsets:
n_sky + frame * n_chunks + chunk, with frames numbered from 0 on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import selection
from .coadd import ratio

MAD_TO_STD = 1.4826
MEAN_WEIGHT = 10


def outliers(obs: DataFrame, threshold: float, *, by: Sequence[str] = ("frame",), value: str = "value", spread: bool = False) -> DataFrame:
    """``obs`` with ``median, mad, is_outlier``: farther from its frame's median than ``threshold`` times 1.4826 times the median of such
    distances. NaN and null values count for neither and are no outliers. Medians are exact. A frame's values must fit one task, unless they are ``spread``:
    then medians are selected by passes over all values, and no task holds a frame."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    if spread:
        near = _beside(obs, selection.quantiles(obs, by, v, [0.5]), by, "median")
        near = _beside(near, selection.quantiles(near, by, F.abs(v - F.col("median")), [0.5]), by, "mad")
    else:
        frame = Window.partitionBy(*by)
        near = obs.withColumn("median", F.median(v).over(frame))
        near = near.withColumn("mad", F.median(F.abs(v - F.col("median"))).over(frame))
    far = F.abs(v - F.col("median")) > F.lit(float(threshold)) * F.lit(MAD_TO_STD) * F.col("mad")
    return near.withColumn("is_outlier", F.coalesce(far, F.lit(False)))


def outlier_bounds(obs: DataFrame, *, by: Sequence[str] = ("frame",), value: str = "value") -> DataFrame:
    """``by, median, mad`` as ``outliers`` has them, one row each: values alone are shuffled, once."""
    v = F.col(value).cast("double")

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, F.get(s, F.floor((n - 1) / 2).cast("int")) * 0.5 + F.get(s, F.floor(n / 2).cast("int")) * 0.5)

    # a null isn't collected
    groups = obs.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(~F.isnan(v), v))).alias("_s")).withColumn("median", middle(F.col("_s")))
    away = groups.withColumn("_s", F.array_sort(F.transform("_s", lambda x: F.abs(x - F.col("median")))))
    return away.select(*by, "median", middle(F.col("_s")).alias("mad"))


def _beside(obs: DataFrame, found: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``obs`` with its group's quantile as ``name``."""
    own = found.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("value").alias(name))
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_{b}"))
    return obs.join(own, same, "left").drop(*[f"_{b}" for b in by])


def dense_rows(obs: DataFrame, group: str, order: Sequence[str], name: str = "row") -> DataFrame:
    """``obs`` with numbers from 0 on without gaps, by ``group`` and then ``order``. No task numbers more than a group; ``group`` must have
    few enough values for a list of their sizes. The list is dealt by ``group`` as the observations are."""
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = obs.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint") - 1
    return obs.withColumn("_within", within).join(starts, group).withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def sky_column(nx: int, y: str = "ref_y", x: str = "ref_x") -> Column:
    return F.col(y).cast("bigint") * nx + F.col(x)


def offset_column(n_sky: int, n_chunks: int, frame: str = "frame", chunk: str = "chunk") -> Column:
    return F.col(frame).cast("bigint") * n_chunks + F.col(chunk) + n_sky


def data_rows(
    obs: DataFrame, ny: int, nx: int, n_chunks: int, *, value: str = "value", weight: str = "weight", share: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """A and b of the observations (``row, frame, ref_y, ref_x, chunk``): w S[p] + w a O[f, c] = w d. Rows of weight 0 or less, or outside the
    reference frame, are left out. An observation that several chunks share has a row of ``obs`` for each, of one ``row`` number."""
    n_sky = ny * nx
    seen = obs.where(F.col(weight) > 0).where(F.col("ref_y").between(0, ny - 1) & F.col("ref_x").between(0, nx - 1))
    a = F.lit(1) if share is None else F.col(share)
    if share is None:  # one chunk each: both entries from one pass
        both = F.explode(F.array(
            F.struct(sky_column(nx).alias("col"), F.col(weight).alias("val")),
            F.struct(offset_column(n_sky, n_chunks).alias("col"), F.col(weight).alias("val")),
        )).alias("e")
        matrix = seen.select("row", both).select("row", "e.col", "e.val")
        return matrix, seen.select("row", (F.col(weight) * F.col(value)).alias("val"))
    once = seen.groupBy("row").agg(F.first(sky_column(nx)).alias("col"), F.first(weight).alias("w"), F.first(value).alias("v"))
    matrix = once.select("row", "col", F.col("w").alias("val")).union(
        seen.select("row", offset_column(n_sky, n_chunks).alias("col"), (F.col(weight) * a).alias("val"))
    )
    return matrix, once.select("row", (F.col("w") * F.col("v")).alias("val"))


def observed_rows(obs: DataFrame, ny: int, nx: int, n_chunks: int, *, value: str = "value", weight: str = "weight") -> DataFrame:
    """The same system as that of ``data_rows`` without shares, a row for each observation: ``sky, off, weight, value``."""
    seen = obs.where(F.col(weight) > 0).where(F.col("ref_y").between(0, ny - 1) & F.col("ref_x").between(0, nx - 1))
    return seen.select(sky_column(nx).alias("sky"), offset_column(ny * nx, n_chunks).alias("off"), F.col(weight).alias("weight"), F.col(value).alias("value"))


def regularisation_rows(frames: DataFrame, adjacency: DataFrame, weight: float, n_sky: int, n_chunks: int) -> DataFrame:
    """A of reg O[i] - reg O[j] = 0 for each frame with data and adjacent pair: ``frame, chunk_i, chunk_j, col, val``; number the rows by the
    first three. The pairs are a table of the instrument."""
    pairs = frames.select("frame").distinct().join(F.broadcast(adjacency.select("chunk_i", "chunk_j")))
    ends = F.explode(F.array(
        F.struct(offset_column(n_sky, n_chunks, chunk="chunk_i").alias("col"), F.lit(weight).alias("val")),
        F.struct(offset_column(n_sky, n_chunks, chunk="chunk_j").alias("col"), F.lit(-weight).alias("val")),
    )).alias("e")
    return pairs.select("frame", "chunk_i", "chunk_j", ends).select("frame", "chunk_i", "chunk_j", "e.col", "e.val")


def mean_rows(frames: DataFrame, n_sky: int, n_chunks: int, *, mean: str = "bias") -> tuple[DataFrame, DataFrame]:
    """A and b that hold each frame's mean offset at ``mean``: 10 sum O[f, c] = 10 n_chunks mean. The row is the frame."""
    each = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
    matrix = frames.select("frame", each).select(F.col("frame").alias("row"), offset_column(n_sky, n_chunks).alias("col"), F.lit(MEAN_WEIGHT).alias("val"))
    return matrix, frames.select(F.col("frame").alias("row"), (F.lit(MEAN_WEIGHT) * n_chunks * F.col(mean)).alias("val"))


def damping_rows(counts: DataFrame, damp: float, n_sky: int) -> DataFrame:
    """A of sqrt(damp count) S[p] = 0 for each observed sky pixel; the row is the column."""
    return counts.where(F.col("col") < n_sky).select(F.col("col").alias("row"), "col", F.sqrt(F.lit(float(damp)) * F.col("n")).alias("val"))


def cleaned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without rows whose b is NaN, and without entries of value 0 where b is 0."""
    b = b.where(~F.isnan(F.col("val").cast("double")))
    met = a.join(b.withColumnRenamed("val", "_b"), "row").where("not (val = 0 and _b = 0)")
    return met.select("row", "col", "val"), b


def entry_counts(a: DataFrame) -> DataFrame:
    """``col, n``: entries of each column."""
    return a.groupBy("col").agg(F.count("*").alias("n"))


def column_norms(a: DataFrame) -> DataFrame:
    """``col, norm``: root of the sum of squares; 1 where that is 0."""
    return a.groupBy("col").agg(F.sum(F.col("val") * F.col("val")).alias("s")).select("col", F.when(F.col("s") > 0, F.sqrt("s")).otherwise(1.0).alias("norm"))


def first_guess(a: DataFrame, b: DataFrame, n_sky: int) -> DataFrame:
    """``col, value``: for each offset column sum(a b) / sum(a a), 0 where that is undefined. The sky starts at 0, which is left out."""
    met = a.where(F.col("col") >= n_sky).join(b.withColumnRenamed("val", "_b"), "row")
    sums = met.groupBy("col").agg(F.sum(F.col("val") * F.col("_b")).alias("p"), F.sum(F.col("val") * F.col("val")).alias("q"))
    return sums.select("col", ratio(F.col("p"), F.col("q")).alias("value"))


def observed_guess(rows: DataFrame, more: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """As ``first_guess``, from ``observed_rows`` and the A and b of rows of offsets alone; rows of A that b lacks don't count."""
    w, v = F.col("weight").cast("double"), F.col("value").cast("double")
    known = rows.where(F.col("off").isNotNull() & w.isNotNull() & v.isNotNull() & ~F.isnan(v))
    sums = known.groupBy(F.col("off").alias("col")).agg(F.sum(w * (w * v)).alias("p"), F.sum(w * w).alias("q"))
    if more is not None:
        met = more[0].join(more[1].withColumnRenamed("val", "_b"), "row")
        sums = sums.unionByName(met.select("col", (F.col("val") * F.col("_b")).alias("p"), (F.col("val") * F.col("val")).alias("q")))
        sums = sums.groupBy("col").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select("col", ratio(F.col("p"), F.col("q")).alias("value"))


def chunk_means(obs: DataFrame, frames: DataFrame, n_chunks: int, *, good: Column | None = None, value: str = "value") -> DataFrame:
    """``frame, chunk, value``: mean of good observations of each chunk (0 and up) in each frame, every pair present, 0 where there are none."""
    kept = obs.where("chunk >= 0")
    kept = kept if good is None else kept.where(good)
    means = kept.groupBy("frame", "chunk").agg(F.avg(value).alias("value"))
    dense = frames.select("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_chunks - 1).cast("bigint"))).alias("chunk"))
    return dense.join(means, ["frame", "chunk"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def coverage(counts: DataFrame, chunk_map: DataFrame, n_sky: int, n_chunks: int) -> DataFrame:
    """``frame, chunk, n, frac``: entries of each offset column, and as a part of its chunk's cells."""
    sizes = chunk_map.where("chunk >= 0").groupBy("chunk").agg(F.count("*").alias("size"))
    off = F.col("col") - n_sky
    found = counts.where(F.col("col") >= n_sky).select(F.floor(off / n_chunks).alias("frame"), (off % n_chunks).alias("chunk"), "n")
    return found.join(F.broadcast(sizes), "chunk", "left").select("frame", "chunk", "n", (F.col("n") / F.greatest(F.coalesce("size", F.lit(1)), F.lit(1))).alias("frac"))


def times(a: DataFrame, x: DataFrame) -> DataFrame:
    """``row, val``: A x, for x as ``col, value``."""
    return a.join(x, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("value")).alias("val"))


def transposed_times(a: DataFrame, u: DataFrame, name: str = "value") -> DataFrame:
    """``col, value``: A' u, for u as ``row, val``."""
    return a.join(u.withColumnRenamed("val", "_u"), "row").groupBy("col").agg(F.sum(F.col("val") * F.col("_u")).alias(name))
