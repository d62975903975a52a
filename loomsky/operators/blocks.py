"""Least squares on observations in blocks of the sky: neither A nor u is ever written, and an iteration shuffles unknowns only.

Observations ``weight (x[sky] + x[off]) = weight value`` are dealt once by block of consecutive sky pixels, and each block is a row of arrays: which of the block's
own unknowns each observation has, and its weight. In Golub and Kahan's process u is asked for only in A' u, and that follows from A' A v: A' u' = (A' A v - alpha A' u) / beta
with beta ** 2 = |A v| ** 2 - alpha ** 2. So an iteration hands each block its unknowns (a row for each unknown of each block), multiplies there by A and by A', and adds up the
blocks' results by unknown. A block must fit a task; its width is chosen from the number of observations, counted first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .solver import Solution, _iterate, _Lsmr, _Lsqr
from .store import Store

#: observations of a block, about
BLOCK = 200_000

_VECTOR = ArrayType(DoubleType())
_PACKED = "block long, cols array<long>, i array<int>, j array<int>, w array<double>, b array<double>"


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's observations as one row: ``cols``, its sky pixels and offsets; ``i, j``, the places in it of each observation's two (j is beyond the last where there is
    no offset); weights, and weights times values."""
    off = rows["off"].to_numpy(dtype="float64", na_value=np.nan)
    has = ~np.isnan(off)
    sky, i = np.unique(rows["sky"].to_numpy(), return_inverse=True)
    offs, at = np.unique(rows["off"][has].to_numpy(dtype="int64"), return_inverse=True)
    j = np.full(len(rows), len(sky) + len(offs), dtype="int32")
    j[has] = len(sky) + at
    w = rows["weight"].to_numpy()
    return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "cols": [np.concatenate([sky, offs])], "i": [i.astype("int32")], "j": [j], "w": [w], "b": [w * rows["value"].to_numpy()]})


def _down(i, j, r, n: int):
    """A' r, without weights."""
    return np.bincount(i, r, n + 1)[:n] + np.bincount(j, r, n + 1)[:n]


@F.pandas_udf(_VECTOR)
def _squares(i: pd.Series, j: pd.Series, w: pd.Series, cols: pd.Series) -> pd.Series:
    return pd.Series([_down(a, b, c * c, len(n)) for a, b, c, n in zip(i, j, w, cols)], dtype=object)


@F.pandas_udf(_VECTOR)
def _normal(i: pd.Series, j: pd.Series, w: pd.Series, v: pd.Series) -> pd.Series:
    """A' A v."""
    out = []
    for a, b, c, x in zip(i, j, w, v):
        x = np.append(x, 0.0)
        out.append(_down(a, b, c * c * (x[a] + x[b]), len(x) - 1))
    return pd.Series(out, dtype=object)


@F.pandas_udf(StructType([StructField("z", _VECTOR), StructField("left", DoubleType()), StructField("all", DoubleType())]))
def _begun(i: pd.Series, j: pd.Series, w: pd.Series, right: pd.Series, v: pd.Series) -> pd.DataFrame:
    """A' (b - A v), and the squares of b - A v and of b."""
    out = []
    for a, b, c, d, x in zip(i, j, w, right, v):
        x = np.append(x, 0.0)
        r = d - c * (x[a] + x[b])
        out.append((_down(a, b, c * r, len(x) - 1), float(r @ r), float(d @ d)))
    return pd.DataFrame(out, columns=["z", "left", "all"])


def width_of(obs: DataFrame, n_sky: int) -> int:
    """Sky pixels of a block, so that it has some ``BLOCK`` of ``obs``, counted now."""
    return max(1, BLOCK * n_sky // max(obs.count(), 1))


def solve_blocks(
    rows: DataFrame,
    width: int,
    *,
    more: tuple[DataFrame, DataFrame] | None = None,
    method: str = "lsmr",
    x0: DataFrame | None = None,
    damp: float = 0.0,
    atol: float = 1e-6,
    btol: float = 1e-6,
    iterations: int = 100,
    precondition: bool = True,
) -> Solution:
    """As ``solver.solve_observed``, with blocks of ``width`` sky pixels (``width_of``)."""
    if method not in ("lsqr", "lsmr"):
        raise ValueError(f"method {method!r} is neither lsqr nor lsmr")
    store = Store(rows.sparkSession)
    try:
        given = rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("sky", "off")], *[F.col(c).cast("double").alias(c) for c in ("weight", "value")])
        given = given.where("sky is not null and weight is not null and value is not null and not isnan(value)")
        system = _Blocks(store, given, width, more, precondition)
        start = system.start(x0)
        size = system.begin(start)
        machine = _Lsqr(damp) if method == "lsqr" else _Lsmr(damp)
        state, n, trace, ok = _iterate(machine, system, size, atol, btol, iterations)
        x = state.select("col", "norm", "x").join(start, "col").select("col", (F.col("x") / F.col("norm") + F.col("v")).alias("value"))
        return Solution(store.keep(x), n, trace[-1] if trace else 0.0, trace, ok)
    finally:
        store.drop("blocks", "seats", "beside", "right", "norms", "start", "state")


class _Blocks:
    """Products with A and A' at once, for ``_iterate``. The state has ``norm``, by which its v is to be divided, and ``atu``, A' u."""

    def __init__(self, store: Store, given: DataFrame, width: int, more: tuple[DataFrame, DataFrame] | None, precondition: bool):
        self.store = store
        spark = given.sparkSession
        self.parts = parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = given.withColumn("block", F.floor(F.col("sky") / width)).repartition(parts, "block")
        self.blocks = store.keep_dealt(dealt.groupBy("block").applyInPandas(_pack, _PACKED), "block", parts, "blocks")
        seats = self.blocks.select("block", F.posexplode("cols").alias("pos", "col"))
        self.seats = store.keep_dealt(seats.repartition(parts, "col"), "col", parts, "seats")
        squares = self._summed(self.blocks.select("cols", _squares("i", "j", "w", "cols").alias("z")))
        self.beside = self.right = None
        if more is not None:
            entries = more[0].groupBy("row", F.col("col").cast("bigint").alias("col")).agg(F.sum(F.col("val").cast("double")).alias("val"))
            self.beside = store.keep(entries, "beside")
            self.right = store.keep(more[1].groupBy("row").agg(F.sum(F.col("val").cast("double")).alias("val")), "right")
            squares = self._with(squares, self.beside.groupBy("col").agg(F.sum(F.col("val") * F.col("val")).alias("z")))
        norm = F.when(F.col("z") > 0, F.sqrt("z")).otherwise(1.0) if precondition else F.lit(1.0)
        self.norms = store.keep_dealt(squares.select("col", norm.alias("norm")), "col", parts, "norms")

    def _summed(self, found: DataFrame) -> DataFrame:
        """``col, z`` of blocks' ``cols, z``."""
        each = found.select(F.explode(F.arrays_zip("cols", "z")).alias("e")).select(F.col("e.cols").alias("col"), F.col("e.z").alias("z"))
        return each.repartition(self.parts, "col").groupBy("col").agg(F.sum("z").alias("z"))

    def _with(self, one: DataFrame, other: DataFrame) -> DataFrame:
        return one.unionByName(other).repartition(self.parts, "col").groupBy("col").agg(F.sum("z").alias("z"))

    def _handed(self, vector: DataFrame) -> DataFrame:
        """Blocks with ``v``, the values of their unknowns in ``vector`` (col, v). The blocks stay where they are."""
        seated = self.seats.join(vector, "col").select("block", "pos", "v").repartition(self.parts, "block")
        seated = seated.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).getField("v").alias("v"))
        return self.blocks.join(seated.hint("shuffle_hash"), "block")

    def _rows(self, vector: DataFrame) -> DataFrame:
        """``row, av`` of the rows beside the observations."""
        return self.beside.join(vector, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("v")).alias("av"))

    def _back(self, r: DataFrame) -> DataFrame:
        return self.beside.join(r, "row").groupBy("col").agg(F.sum(F.col("val") * F.col("r")).alias("z"))

    def start(self, x0: DataFrame | None) -> DataFrame:
        """``col, v`` of each unknown at the start."""
        if x0 is None:
            return self.norms.select("col", F.lit(0.0).alias("v"))
        found = self.norms.join(x0.select("col", F.col("value").cast("double").alias("_x")), "col", "left").select("col", F.coalesce("_x", F.lit(0.0)).alias("v"))
        return self.store.keep_dealt(found, "col", self.parts, "start")

    def begin(self, start: DataFrame) -> float:
        """Take the start off b, and return b's norm."""
        met = self._handed(start).select("cols", _begun("i", "j", "w", "b", "v").alias("f"))
        found = self.store.keep(met.select("cols", "f.z", "f.left", "f.all"), "begun")
        left, whole = found.agg(F.sum("left"), F.sum("all")).first()
        left, whole = left or 0.0, whole or 0.0
        self.atb = self._summed(found)
        if self.beside is not None:
            r = self.right.join(self._rows(start), "row", "full").select("row", F.coalesce("val", F.lit(0.0)).alias("b"), (F.coalesce("val", F.lit(0.0)) - F.coalesce("av", F.lit(0.0))).alias("r"))
            more = r.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("b") * F.col("b"))).first()
            left, whole = left + (more[0] or 0.0), whole + (more[1] or 0.0)
            self.atb = self._with(self.atb, self._back(r))
        self.beta = math.sqrt(left)
        return math.sqrt(whole)

    def _kept(self, state: DataFrame) -> DataFrame:
        return self.store.keep_dealt(state, "col", self.parts, "state")

    def first(self, columns: tuple[str, ...]) -> DataFrame:
        atu = F.coalesce("z", F.lit(0.0)) / F.col("norm") / (self.beta or 1.0)
        state = self.norms.join(self.atb, "col", "left").select("col", "norm", atu.alias("atu"), F.lit(0.0).alias("x"), *[F.lit(0.0).alias(c) for c in columns])
        state = self._kept(state.withColumn("v", F.col("atu")))
        self.store.drop("begun")
        return state

    def forward(self, state: DataFrame, alpha: float) -> float:
        vector = state.select("col", (F.col("v") / F.col("norm")).alias("v"))
        z = self._summed(self._handed(vector).select("cols", _normal("i", "j", "w", "v").alias("z")))
        if self.beside is not None:
            z = self._with(z, self._back(self._rows(vector).withColumnRenamed("av", "r")))
        self.state = self._kept(state.join(z, "col", "left").withColumn("z", F.coalesce("z", F.lit(0.0)) / F.col("norm")))
        square = self.state.agg(F.sum(F.col("v") * F.col("z"))).first()[0] or 0.0
        rest = square - alpha * alpha
        self.alpha = alpha
        return math.sqrt(rest) if rest > 1e-14 * square else 0.0  # less is rounding

    def backward(self, state: DataFrame, beta: float) -> DataFrame:
        atu = (F.col("z") - self.alpha * F.col("atu")) / beta if beta else F.lit(0.0)
        return self.state.withColumn("atu", atu).drop("z").withColumn("_v", F.col("atu") - beta * F.col("v"))
