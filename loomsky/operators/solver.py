"""Iterative least squares on long tables: LSQR (Paige and Saunders, 1982) and LSMR (Fong and Saunders, 2011).

Vectors are tables keyed by row or column; an iteration is two join-aggregations and two norms, the only numbers that reach the driver.
Vectors are written to the shared folder (``spark.checkpoint.dir``) in each iteration, so that plans stay short and lost executors
cost no more than the current step. Where the unknowns, counted first, are few enough to broadcast, A is dealt by row alone and products stay where
they are; beyond that it is kept twice, dealt by row and by column, so that only vectors are shuffled.

``solve_observed`` needs no A. Observations, each of one sky pixel and one offset, are a table of buckets by sky pixel, in which each carries its own
part of u. The unknowns are a table of as many buckets, so neither observations nor u ever move again: a step shuffles sums by offset.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .system import column_norms


@dataclass
class Solution:
    """``x`` is ``col, value``; columns without entries are absent and count as 0."""

    x: DataFrame
    iterations: int
    residual: float
    residuals: list[float]
    converged: bool


#: unknowns up to which a vector is broadcast: 16 bytes of numbers each, some 64 MB as a hash table
SMALL = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; nothing deletes it."""
    return Store(df.sparkSession).keep(df)


def _norm(df: DataFrame, column: str = "v") -> float:
    return math.sqrt(df.agg(F.sum(F.col(column) * F.col(column))).first()[0] or 0.0)


def solve(
    a: DataFrame,
    b: DataFrame,
    *,
    method: str = "lsmr",
    x0: DataFrame | None = None,
    damp: float = 0.0,
    atol: float = 1e-6,
    btol: float = 1e-6,
    iterations: int = 100,
    precondition: bool = True,
) -> Solution:
    """Minimise ||A x - b|| ** 2 + damp ** 2 ||x - x0|| ** 2, the second norm in preconditioned unknowns.

    ``a`` is ``row, col, val`` (entries of one place add up), ``b`` is ``row, val``, ``x0`` is ``col, value``. ``precondition`` scales columns to norm 1.
    Stops when the residual, or its gradient, is small enough, or after ``iterations``."""
    if method not in ("lsqr", "lsmr"):
        raise ValueError(f"method {method!r} is neither lsqr nor lsmr")
    a = a.select("row", "col", F.col("val").cast("double").alias("val"))
    store = Store(a.sparkSession)
    norms = store.keep(column_norms(a) if precondition else a.select("col").distinct().withColumn("norm", F.lit(1.0)), "norms")
    small = norms.count() <= SMALL
    if precondition:
        a = a.join(F.broadcast(norms) if small else norms, "col").select("row", "col", (F.col("val") / F.col("norm")).alias("val"))
    by_row = a.repartition("row").persist(StorageLevel.MEMORY_AND_DISK)
    by_col = by_row if small else a.repartition("col").persist(StorageLevel.MEMORY_AND_DISK)

    def times(x: DataFrame) -> DataFrame:
        return by_col.join(F.broadcast(x) if small else x, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("v")).alias("av"))

    def back(u: DataFrame) -> DataFrame:
        return by_row.join(u, "row").groupBy("col").agg(F.sum(F.col("val") * F.col("u")).alias("atu"))

    try:
        right = b.groupBy("row").agg(F.sum(F.col("val").cast("double")).alias("u"))
        if x0 is None:
            start = norms.select("col", F.lit(0.0).alias("v"))
            right = store.keep(right, "u")
            size = _norm(right, "u")
        else:
            start = norms.join(x0, "col", "left").select("col", (F.coalesce(F.col("value").cast("double"), F.lit(0.0)) * F.col("norm")).alias("v"))
            start = store.keep(start, "start")
            right = right.join(times(start), "row", "full")
            right = store.keep(right.select("row", "u", (F.coalesce("u", F.lit(0.0)) - F.coalesce("av", F.lit(0.0))).alias("left")), "u")
            size = _norm(right, "u")
            right = right.select("row", F.col("left").alias("u"))
        machine = _Lsqr(damp) if method == "lsqr" else _Lsmr(damp)
        state, n, trace, ok = _iterate(machine, _Long(times, back, store, right), size, atol, btol, iterations)
        x = state.join(start.withColumnRenamed("v", "_start"), "col").join(norms, "col")
        x = x.select("col", ((F.col("x") + F.col("_start")) / F.col("norm")).alias("value"))
        return Solution(store.keep(x), n, trace[-1] if trace else 0.0, trace, ok)
    finally:
        store.drop("norms", "start", "u", "state")
        by_row.unpersist()
        if by_col is not by_row:
            by_col.unpersist()


class _Long:
    """Products with A as a long table, and u as a table by row."""

    def __init__(self, times, back, store: Store, u: DataFrame):
        self.times, self.back, self.store = times, back, store
        self.beta = _norm(u, "u")
        self.u = u.select("row", (F.col("u") / (self.beta or 1.0)).alias("u"))

    def first(self, columns: tuple[str, ...]) -> DataFrame:
        return self.store.keep(self.back(self.u).select("col", F.col("atu").alias("v"), F.lit(0.0).alias("x"), *[F.lit(0.0).alias(c) for c in columns]), "state")

    def forward(self, state: DataFrame, alpha: float) -> float:
        u = self.times(state).join(self.u, "row", "full").select("row", (F.coalesce("av", F.lit(0.0)) - alpha * F.coalesce("u", F.lit(0.0))).alias("u"))
        u = self.store.keep(u, "u")
        beta = _norm(u, "u")
        self.u = u.select("row", (F.col("u") / (beta or 1.0)).alias("u"))
        return beta

    def backward(self, state: DataFrame, beta: float) -> DataFrame:
        state = state.join(self.back(self.u), "col", "left").withColumn("_v", F.coalesce("atu", F.lit(0.0)) - beta * F.col("v")).drop("atu")
        return self.store.keep(state, "state")


def _iterate(machine, system, size: float, atol: float, btol: float, limit: int):
    """Golub and Kahan's bidiagonalisation, with a ``machine`` that turns its numbers into the next solution.

    The state is one table, ``col, v, x`` and the machine's own columns. A round writes two tables: the ``system``'s new u, and the state with
    what A' u adds to v; those before them are deleted. Scaling by norms and the machine's updates are projections of what was written."""
    beta = system.beta
    state = system.first(machine.columns)
    alpha = _norm(state)
    state = machine.begin(state.withColumn("v", F.col("v") / (alpha or 1.0)), alpha, beta)
    if alpha * beta == 0:
        return state, 0, [beta], True
    frobenius, trace = alpha**2, []
    for n in range(1, limit + 1):
        beta = system.forward(state, alpha)
        state = system.backward(state, beta)
        alpha, x_norm = state.agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))), F.sqrt(F.sum(F.col("x") * F.col("x")))).first()
        frobenius += alpha**2 + beta**2
        state, residual, gradient = machine.step(state.withColumn("v", F.col("_v") / (alpha or 1.0)).drop("_v"), alpha, beta)
        trace.append(residual)
        scale = math.sqrt(frobenius)
        if residual <= btol * size + atol * scale * x_norm or gradient <= atol * scale * max(residual, 1e-300) or alpha * beta == 0:
            return state, n, trace, True
    return state, limit, trace, False


def solve_observed(
    rows: DataFrame,
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
    """As ``solve``, for a system that is never written out: ``rows`` (``sky, off, weight, value``) stand for weight (x[sky] + x[off]) = weight value.
    ``sky`` and ``off`` are columns of their own numbers; a row without ``off`` is of its sky pixel alone, as damping is. Rows without a sky pixel,
    weight or value (or with NaN as their value) count for nothing. ``more`` is A and b of rows of offsets alone, as regularisation and means are. Offsets are broadcast while they are
    at most ``SMALL``, counted first; beyond that observations are joined with them by shuffling."""
    if method not in ("lsqr", "lsmr"):
        raise ValueError(f"method {method!r} is neither lsqr nor lsmr")
    spark = rows.sparkSession
    store, parts = Store(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1.0)
    try:
        given = rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("sky", "off")], *[F.col(c).cast("double").alias(c) for c in ("weight", "value")])
        given = given.where("sky is not null and weight is not null and value is not null and not isnan(value)")
        given = store.keep_dealt(given.repartition(parts, "sky"), "sky", parts, "given")
        square = F.sum(F.col("weight") * F.col("weight")).alias("_s")
        offsets = given.where("off is not null").groupBy(F.col("off").alias("col")).agg(square)
        beside = None
        if more is not None:
            beside = store.keep(more[0].select("row", F.col("col").cast("bigint").alias("col"), F.col("val").cast("double").alias("val")), "unscaled")
            offsets = offsets.union(beside.select("col", F.col("val") * F.col("val"))).groupBy("col").agg(F.sum("_s").alias("_s"))
        norm = F.when(F.col("_s") > 0, F.sqrt("_s")).otherwise(one) if precondition else one
        is_sky = F.lit(True).alias("is_sky")
        both = given.groupBy(F.col("sky").alias("col")).agg(square).select("col", norm.alias("norm"), is_sky).union(offsets.select("col", norm.alias("norm"), F.lit(False)))
        norms = store.keep_dealt(both.repartition(parts, "col"), "col", parts, "norms")
        small = norms.where("not is_sky").count() <= SMALL
        start = norms.withColumn("v", F.lit(0.0))
        if x0 is not None:
            start = norms.join(x0.select("col", F.col("value").cast("double").alias("_x")), "col", "left")
            start = start.select("col", "norm", "is_sky", (F.coalesce("_x", F.lit(0.0)) * F.col("norm")).alias("v"))
        start = store.keep_dealt(start.repartition(parts, "col"), "col", parts, "start")
        system = _Observed(store, parts, norms, small)
        size = system.begin(given, start, beside, None if more is None else more[1])
        machine = _Lsqr(damp) if method == "lsqr" else _Lsmr(damp)
        state, n, trace, ok = _iterate(machine, system, size, atol, btol, iterations)
        x = state.select("col", "x").join(start.select("col", "norm", F.col("v").alias("_start")), "col")
        x = store.keep(x.select("col", ((F.col("x") + F.col("_start")) / F.col("norm")).alias("value")))
        return Solution(x, n, trace[-1] if trace else 0.0, trace, ok)
    finally:
        store.drop("given", "unscaled", "norms", "start", "beside", "rows", "more", "state")


class _Observed:
    """Products with observations in buckets by sky pixel (``sky, off, s, o, u``: s and o are a row's two entries of A, scaled) and with rows of offsets
    alone (``beside`` of A, ``more`` of u)."""

    def __init__(self, store: Store, parts: int, norms: DataFrame, small: bool):
        self.store, self.parts, self.norms, self.small = store, parts, norms, small
        self.beside = self.more = None

    def _split(self, table: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        """``table`` of unknowns as sky (``sky``) and offsets (``off``), with ``columns`` renamed so that they don't clash."""
        sky = table.where("is_sky").select(F.col("col").alias("sky"), *[F.col(c).alias(f"_sky_{c}") for c in columns])
        off = table.where("not is_sky").select(F.col("col").alias("off"), *[F.col(c).alias(f"_off_{c}") for c in columns])
        return sky.hint("shuffle_hash"), F.broadcast(off) if self.small else off

    def begin(self, given: DataFrame, start: DataFrame, beside: DataFrame | None, right: DataFrame | None) -> float:
        """Scale A, take the start off b, and return b's norm."""
        sky, off = self._split(start, "norm", "v")
        s, o = F.col("weight") / F.col("_sky_norm"), F.when(F.col("off").isNotNull(), F.col("weight") / F.col("_off_norm")).otherwise(0.0)
        rows = given.join(sky, "sky").join(off, "off", "left").withColumns({"s": s, "o": o})
        left = F.col("weight") * F.col("value") - F.col("s") * F.col("_sky_v") - F.col("o") * F.coalesce("_off_v", F.lit(0.0))
        self.rows = self._written(rows.withColumn("u", left))
        size = given.agg(F.sum((F.col("weight") * F.col("value")) ** 2)).first()[0] or 0.0
        if beside is not None:
            scaled = beside.join(off.withColumnRenamed("off", "col"), "col").withColumn("val", F.col("val") / F.col("_off_norm"))
            at = scaled.groupBy("row").agg(F.sum(F.col("val") * F.col("_off_v")).alias("_av"))
            right = right.groupBy("row").agg(F.sum(F.col("val").cast("double")).alias("_b"))
            self.beside = self.store.keep(scaled.select("row", "col", "val"), "beside")
            self.more = self.store.keep(at.join(right, "row", "full").select("row", F.coalesce("_b", F.lit(0.0)).alias("b"), (F.coalesce("_b", F.lit(0.0)) - F.coalesce("_av", F.lit(0.0))).alias("u")), "more")
            size += self.more.agg(F.sum(F.col("b") * F.col("b"))).first()[0] or 0.0
        self.beta = self._scale()
        return math.sqrt(size)

    def _written(self, rows: DataFrame) -> DataFrame:
        return self.store.keep_dealt(rows.select("sky", "off", "s", "o", "u"), "sky", self.parts, "rows")

    def _scale(self) -> float:
        """The norm of u, which u is divided by from here on."""
        beta = math.hypot(_norm(self.rows, "u"), _norm(self.more, "u") if self.more is not None else 0.0)
        self.rows = self.rows.withColumn("u", F.col("u") / (beta or 1.0))
        if self.more is not None:
            self.more = self.more.select("row", (F.col("u") / (beta or 1.0)).alias("u"))
        return beta

    def product(self, state: DataFrame, alpha: float) -> DataFrame:
        """Observations with A v - alpha u as their u."""
        sky, off = self._split(state, "v")
        met = self.rows.join(sky, "sky").join(off, "off", "left")
        return met.withColumn("u", F.col("s") * F.col("_sky_v") + F.col("o") * F.coalesce("_off_v", F.lit(0.0)) - alpha * F.col("u"))

    def added(self, state: DataFrame) -> DataFrame:
        """``state`` with ``atu``, what A' u adds to each unknown."""
        u = F.col("u")
        sky = self.rows.groupBy(F.col("sky").alias("col")).agg(F.sum(F.col("s") * u).alias("_atu_s"))
        off = self.rows.where("off is not null").groupBy(F.col("off").alias("col")).agg(F.sum(F.col("o") * u).alias("_atu_o"))
        if self.more is not None:
            beside = self.beside.join(self.more, "row").select("col", F.col("val") * u)
            off = off.union(beside).groupBy("col").agg(F.sum("_atu_o").alias("_atu_o"))
        met = state.join(sky.hint("shuffle_hash"), "col", "left").join(F.broadcast(off) if self.small else off, "col", "left")
        return met.withColumn("atu", F.coalesce("_atu_s", "_atu_o", F.lit(0.0))).drop("_atu_s", "_atu_o")

    def first(self, columns: tuple[str, ...]) -> DataFrame:
        state = self.added(self.norms.select("col", "is_sky"))
        state = state.select("col", "is_sky", F.col("atu").alias("v"), F.lit(0.0).alias("x"), *[F.lit(0.0).alias(c) for c in columns])
        return self.store.keep_dealt(state, "col", self.parts, "state")

    def forward(self, state: DataFrame, alpha: float) -> float:
        met = self.product(state, alpha)
        if self.more is not None:
            v = state.where("not is_sky").select("col", "v")
            at = self.beside.join(F.broadcast(v) if self.small else v, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("v")).alias("_av"))
            more = self.more.join(at, "row", "left").select("row", (F.coalesce("_av", F.lit(0.0)) - alpha * F.col("u")).alias("u"))
            self.more = self.store.keep(more, "more")
        self.rows = self._written(met)
        return self._scale()

    def backward(self, state: DataFrame, beta: float) -> DataFrame:
        state = self.added(state).withColumn("_v", F.col("atu") - beta * F.col("v")).drop("atu")
        return self.store.keep_dealt(state, "col", self.parts, "state")


class _Lsqr:
    columns = ("w",)

    def __init__(self, damp: float):
        self.damp, self.tail = damp, 0.0

    def begin(self, state: DataFrame, alpha: float, beta: float) -> DataFrame:
        self.phi_bar, self.rho_bar = beta, alpha
        return state.withColumn("w", F.col("v"))

    def step(self, state: DataFrame, alpha: float, beta: float) -> tuple[DataFrame, float, float]:
        damped = math.hypot(self.rho_bar, self.damp)
        self.tail += (self.damp / damped * self.phi_bar) ** 2
        phi_bar = self.rho_bar / damped * self.phi_bar
        rho = math.hypot(damped, beta)
        c, s = damped / rho, beta / rho
        theta, phi = s * alpha, c * phi_bar
        self.rho_bar, self.phi_bar = -c * alpha, s * phi_bar
        state = state.withColumns({"x": F.col("x") + phi / rho * F.col("w"), "w": F.col("v") - theta / rho * F.col("w")})
        return state, math.sqrt(self.phi_bar**2 + self.tail), alpha * abs(s * phi)


class _Lsmr:
    columns = ("h", "g")  # g is the paper's h-bar

    def __init__(self, damp: float):
        self.damp = damp

    def begin(self, state: DataFrame, alpha: float, beta: float) -> DataFrame:
        self.zeta_bar, self.alpha_bar, self.rho, self.rho_bar, self.c_bar, self.s_bar = alpha * beta, alpha, 1.0, 1.0, 1.0, 0.0
        self.beta_dd, self.beta_d, self.rho_d, self.tau, self.theta_tilde, self.zeta, self.d = beta, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0
        return state.withColumn("h", F.col("v"))

    def step(self, state: DataFrame, alpha: float, beta: float) -> tuple[DataFrame, float, float]:
        hat = math.hypot(self.alpha_bar, self.damp)
        c_hat, s_hat = self.alpha_bar / hat, self.damp / hat
        rho_old, rho_bar_old, zeta_old = self.rho, self.rho_bar, self.zeta
        self.rho = math.hypot(hat, beta)
        c, s = hat / self.rho, beta / self.rho
        theta, self.alpha_bar = s * alpha, c * alpha
        theta_bar, temp = self.s_bar * self.rho, self.c_bar * self.rho
        self.rho_bar = math.hypot(temp, theta)
        self.c_bar, self.s_bar = temp / self.rho_bar, theta / self.rho_bar
        self.zeta, self.zeta_bar = self.c_bar * self.zeta_bar, -self.s_bar * self.zeta_bar
        g = F.col("h") - theta_bar * self.rho / (rho_old * rho_bar_old) * F.col("g")
        state = state.withColumn("g", g).withColumns({
            "x": F.col("x") + self.zeta / (self.rho * self.rho_bar) * F.col("g"), "h": F.col("v") - theta / self.rho * F.col("h"),
        })
        # The norm of the residual, by the second rotation of the bidiagonal's triangle.
        acute, check = c_hat * self.beta_dd, -s_hat * self.beta_dd
        turned, self.beta_dd = c * acute, -s * acute
        rho_tilde = math.hypot(self.rho_d, theta_bar)
        c_tilde, s_tilde, theta_old = self.rho_d / rho_tilde, theta_bar / rho_tilde, self.theta_tilde
        self.theta_tilde, self.rho_d = s_tilde * self.rho_bar, c_tilde * self.rho_bar
        self.beta_d = -s_tilde * self.beta_d + c_tilde * turned
        self.tau = (zeta_old - theta_old * self.tau) / rho_tilde
        last = (self.zeta - self.theta_tilde * self.tau) / self.rho_d
        self.d += check**2
        return state, math.sqrt(self.d + (self.beta_d - last) ** 2 + self.beta_dd**2), abs(self.zeta_bar)


def sky_and_offsets(x: DataFrame, nx: int, n_sky: int, n_chunks: int) -> tuple[DataFrame, DataFrame]:
    """``ref_y, ref_x, value`` and ``frame, chunk, value`` of a solution's columns."""
    sky = x.where(F.col("col") < n_sky).select(F.expr(f"col div {nx}").alias("ref_y"), F.expr(f"col % {nx}").alias("ref_x"), "value")
    off = x.where(F.col("col") >= n_sky).withColumn("_o", F.col("col") - n_sky)
    return sky, off.select(F.expr(f"_o div {n_chunks}").alias("frame"), F.expr(f"_o % {n_chunks}").alias("chunk"), "value")


def columns_of(sky: DataFrame, offsets: DataFrame, nx: int, n_sky: int, n_chunks: int) -> DataFrame:
    """The inverse of ``sky_and_offsets``: ``col, value``."""
    one = sky.select((F.col("ref_y") * nx + F.col("ref_x")).alias("col"), "value")
    return one.unionByName(offsets.select((F.col("frame") * n_chunks + F.col("chunk") + n_sky).alias("col"), "value"))
