"""Interpolation that is linear between points, or keeps the means of bins, along an axis and on a surface.

A function with given means over bins is the derivative of one that passes through the running integral at the bins' edges. Between two edges that
integral is a cubic fixed by its slopes there, so a kind of spline is a rule for the slopes. The rules of pchip and akima look at neighbouring
bins and are window expressions; the cubic one solves a banded system for each series, along an array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import run_bins


def linear(knots: DataFrame, targets: DataFrame, by: Sequence[str], *, x: str = "x", y: str = "y") -> DataFrame:
    """``by, x, y`` at each of ``targets`` (by, x), between the nearest of ``knots`` (by, x, y); beyond the ends, the end's value."""
    line = Window.partitionBy(*by).orderBy(x, F.col("_knot").desc())
    both = knots.select(*by, x, y, F.lit(1).alias("_knot")).unionByName(targets.select(*by, x, F.lit(None).cast("double").alias(y), F.lit(0).alias("_knot")))
    point = F.when(F.col("_knot") == 1, F.struct(x, y))
    both = both.withColumns({
        "_l": F.last(point, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "_r": F.first(point, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing)),
    })
    l, r, at = F.col("_l"), F.col("_r"), F.col(x)
    between = l[y] + (r[y] - l[y]) * (at - l[x]) / F.nullif(r[x] - l[x], F.lit(0))
    return both.where("_knot = 0").select(*by, x, F.coalesce(F.when(l[x] == at, l[y]), between, l[y], r[y]).alias(y))


def edge_slopes(bins: DataFrame, by: Sequence[str], kind: str, *, low: str = "low", high: str = "high", mean: str = "mean") -> DataFrame:
    """``bins`` with ``d0, d1``: what the function is at each bin's edges. ``kind`` is ``pchip``, ``akima`` or ``cubic`` (not-a-knot)."""
    if kind == "cubic":
        return _cubic(bins, by, low, high, mean)
    line = Window.partitionBy(*by).orderBy(low)

    def m(k: int) -> Column:
        return (F.lag(mean, -k) if k < 0 else F.lead(mean, k)).over(line) if k else F.col(mean)

    def before(k: int) -> Column:
        return F.lag(mean, k).over(line)

    h = F.col(high) - F.col(low)
    b = bins.withColumns({"_h": h, "_m1": before(1), "_m2": before(2), "_p1": F.lead(mean).over(line), "_p2": F.lead(mean, 2).over(line)})
    b = b.withColumns({"_h1": F.lag("_h").over(line), "_hp": F.lead("_h").over(line)})
    now, one, nxt = F.col(mean), F.col("_m1"), F.col("_p1")
    if kind == "pchip":

        def inner(a: Column, c: Column, ha: Column, hc: Column) -> Column:
            w1, w2 = 2 * hc + ha, hc + 2 * ha
            return F.when(a * c > 0, (w1 + w2) / (w1 / F.nullif(a, F.lit(0)) + w2 / F.nullif(c, F.lit(0)))).otherwise(0.0)

        def end(a: Column, c: Column, ha: Column, hc: Column) -> Column:
            d = ((2 * ha + hc) * a - ha * c) / (ha + hc)
            d = F.when(d * a <= 0, 0.0).when((a * c <= 0) & (F.abs(d) > 3 * F.abs(a)), 3 * a).otherwise(d)
            return F.coalesce(d, a)  # a single bin is flat

        d0 = F.when(one.isNull(), end(now, nxt, F.col("_h"), F.col("_hp"))).otherwise(inner(one, now, F.col("_h1"), F.col("_h")))
        d1 = F.when(nxt.isNull(), end(now, one, F.col("_h"), F.col("_h1"))).otherwise(inner(now, nxt, F.col("_h"), F.col("_hp")))
    elif kind == "akima":
        # Beyond the ends the means go on in a line.
        nxt = F.coalesce(nxt, 2 * now - one, now)
        one = F.coalesce(one, 2 * now - nxt, now)
        two = F.coalesce(F.col("_m2"), 2 * one - now)
        far = F.coalesce(F.col("_p2"), 2 * nxt - now)

        def slope(a: Column, b_: Column, c: Column, d: Column) -> Column:
            w1, w2 = F.abs(d - c), F.abs(b_ - a)
            return F.when(w1 + w2 > 0, (w1 * b_ + w2 * c) / F.nullif(w1 + w2, F.lit(0.0))).otherwise((b_ + c) / 2)

        d0, d1 = slope(two, one, now, nxt), slope(one, now, nxt, far)
    else:
        raise ValueError(f"kind {kind!r} is none of pchip, akima, cubic")
    return b.withColumns({"d0": d0, "d1": d1}).drop("_h", "_h1", "_hp", "_m1", "_m2", "_p1", "_p2")


def cubic_slopes(edges: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Slopes at the edges of the not-a-knot cubic spline through the running integral of ``means``; several columns of means at once."""
    n, h = len(means), np.diff(edges)
    if n == 1:
        return np.repeat(means, 2, axis=0)
    if n == 2:  # a single parabola
        d = (h[0] * means[1] + h[1] * means[0]) / (h[0] + h[1])
        return np.stack([2 * means[0] - d, d, 2 * means[1] - d])
    a, r = np.zeros((n + 1, n + 1)), np.zeros((n + 1, *means.shape[1:]))
    for i in range(1, n):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        r[i] = 3 * (h[i] * means[i - 1] + h[i - 1] * means[i])
    a[0, :2] = h[1], h[0] + h[1]
    r[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * means[0] + h[0] ** 2 * means[1]) / (h[0] + h[1])
    a[n, n - 1 :] = h[-1] + h[-2], h[-2]
    r[n] = (h[-1] ** 2 * means[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * means[-1]) / (h[-1] + h[-2])
    return np.linalg.solve(a, r)


def _cubic(bins: DataFrame, by: Sequence[str], low: str, high: str, mean: str) -> DataFrame:
    """``bins`` with the not-a-knot slopes: a tridiagonal system for each series of bins, eliminated forward and solved backward along an array."""
    rest = [c for c in bins.columns if c not in by]
    series = bins.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(low).cast("double").alias("_low"), F.struct(*rest).alias("_bin")))).alias("_s"))
    series = series.withColumns({
        "_n": F.size("_s"), "_m": F.transform("_s", lambda e: e["_bin"][mean].cast("double")),
        "_h": F.transform("_s", lambda e, i: F.coalesce(F.get("_s", i + 1)["_low"], e["_bin"][high].cast("double")) - e["_low"]),
    })

    def h(i: Column | int) -> Column:
        return F.get("_h", i if isinstance(i, Column) else F.lit(i))

    def m(i: Column | int) -> Column:
        return F.get("_m", i if isinstance(i, Column) else F.lit(i))

    def row(a: Column, b: Column, c: Column, r: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), r.alias("r"))

    n, zero = F.col("_n"), F.lit(0.0)
    first = row(zero, h(1), h(0) + h(1), ((h(0) + 2 * (h(0) + h(1))) * h(1) * m(0) + h(0) * h(0) * m(1)) / (h(0) + h(1)))
    last = row(
        h(n - 1) + h(n - 2), h(n - 2), zero, (h(n - 1) * h(n - 1) * m(n - 2) + (2 * (h(n - 1) + h(n - 2)) + h(n - 1)) * h(n - 2) * m(n - 1)) / (h(n - 1) + h(n - 2))
    )
    inner = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: row(h(i), 2 * (h(i - 1) + h(i)), h(i - 1), 3 * (h(i) * m(i - 1) + h(i - 1) * m(i))))
    series = series.withColumn("_rows", F.when(n > 2, F.concat(F.array(first), inner, F.array(last))))

    def eliminate(done: Column, e: Column) -> Column:
        c, r = F.coalesce(F.get(done, F.size(done) - 1)["c"], zero), F.coalesce(F.get(done, F.size(done) - 1)["r"], zero)
        return F.concat(done, F.array(F.struct((e["c"] / (e["b"] - e["a"] * c)).alias("c"), ((e["r"] - e["a"] * r) / (e["b"] - e["a"] * c)).alias("r"))))

    series = series.withColumn("_rows", F.aggregate("_rows", F.array().cast("array<struct<c: double, r: double>>"), eliminate))
    solved = F.aggregate(
        F.reverse("_rows"), F.array().cast("array<double>"), lambda done, e: F.concat(F.array(e["r"] - e["c"] * F.coalesce(F.get(done, F.lit(0)), zero)), done)
    )
    one = F.try_divide(h(0) * m(1) + h(1) * m(0), h(0) + h(1))
    two = F.array(2 * m(0) - one, one, 2 * m(1) - one)  # a single parabola
    series = series.withColumn("_d", F.when(n == 1, F.array(m(0), m(0))).when(n == 2, two).otherwise(solved))
    each = series.select(*by, "_d", F.posexplode("_s").alias("_i", "_e")).select(*by, "_d", "_i", "_e._bin.*")
    return each.select(*bins.columns, F.get("_d", F.col("_i")).alias("d0"), F.get("_d", F.col("_i") + 1).alias("d1"))


def mean_preserving(at: Column, *, low: str = "low", high: str = "high", mean: str = "mean") -> Column:
    """The function at ``at``, in a bin with the slopes of ``edge_slopes``."""
    s = (at - F.col(low)) / (F.col(high) - F.col(low))
    return F.col(mean) * (6 * s - 6 * s * s) + F.col("d0") * (1 - 4 * s + 3 * s * s) + F.col("d1") * (3 * s * s - 2 * s)


def weights(edges: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Matrix that turns the means of bins into the cubic mean-preserving function at places ``at``."""
    n = len(edges) - 1
    d = cubic_slopes(edges, np.eye(n))
    i = np.clip(np.searchsorted(edges, at, side="right") - 1, 0, n - 1)
    s = ((at - edges[i]) / np.diff(edges)[i])[:, None]
    return np.eye(n)[i] * (6 * s - 6 * s * s) + d[i] * (1 - 4 * s + 3 * s * s) + d[i + 1] * (3 * s * s - 2 * s)


def surface(offsets: DataFrame, *, by: Sequence[str] = ("frame",), row: str = "sub", col: str = "col", value: str = "value", factor: int = 1, fill: bool = False) -> DataFrame:
    """``by, y, x, value``: offsets of a grid of bins as a smooth surface that keeps each bin's mean, at the centres of ``factor`` by
    ``factor`` parts of each bin. Zeros are missing; with ``fill`` they are filled first. The surface covers the box of those that aren't; a frame
    without any gives no rows. The surface is a product: along each column of bins first, then along each line of parts."""
    there = offsets.where(F.col(value) != 0)
    box = there.groupBy(*by).agg(F.min(row).alias("_r0"), F.max(row).alias("_r1"), F.min(col).alias("_c0"), F.max(col).alias("_c1"))
    every = box.select(*by, F.explode(F.sequence("_r0", "_r1")).alias(row), "_c0", "_c1").select(*by, row, F.explode(F.sequence("_c0", "_c1")).alias(col))
    filled = fill_linear(offsets, by=by, row=row, col=col, value=value) if fill else offsets
    cells = every.join(filled.select(*by, row, col, F.col(value).cast("double").alias("mean")), [*by, row, col], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    parts = F.explode(F.array(*[F.lit((k + 0.5) / factor) for k in range(factor)])).alias("_part")

    def along(bins: DataFrame, lines: list[str], axis: str, out: str) -> DataFrame:
        placed = bins.withColumns({"low": F.col(axis).cast("double"), "high": F.col(axis) + 1.0})
        each = edge_slopes(placed, lines, "cubic").select("*", parts).withColumn(out, F.col("low") + F.col("_part"))
        return each.select(*lines, out, mean_preserving(F.col(out)).alias("mean"))

    tall = along(cells, [*by, col], row, "y")
    return along(tall, [*by, "y"], col, "x").select(*by, "y", "x", F.col("mean").alias("value"))


def radial(offsets: DataFrame, radii: Sequence[float], pixels: DataFrame, *, kind: str = "cubic", r: str = "r") -> DataFrame:
    """``pixels`` (chunk, r) of every frame with ``value``: offsets (frame, chunk, value) as a smooth function of the distance ``r`` to the
    arcs' centre, which keeps each chunk's mean. Chunk i lies between radii i - 1 and i, a table of the instrument; the outermost chunks, which
    have one radius only, and chunks without an offset are left out."""
    edges = F.array(*[F.lit(float(x)) for x in radii])
    inside = offsets.where(F.col("chunk").between(1, len(radii) - 1))
    bins = inside.select(
        "frame", "chunk", F.get(edges, (F.col("chunk") - 1).cast("int")).alias("low"), F.get(edges, F.col("chunk").cast("int")).alias("high"), F.col("value").alias("mean")
    )
    slopes = edge_slopes(bins, ["frame"], kind)
    return pixels.join(slopes, "chunk").withColumn("value", mean_preserving(F.col(r))).drop("low", "high", "mean", "d0", "d1")


def by_runs(series: DataFrame, by: Sequence[str], order: str, value: str, *, kind: str = "pchip") -> DataFrame:
    """``series`` (by, order: consecutive integers, value) with ``smooth``: its runs of equal values as bins, whose means the function keeps, at the
    middle of each place. Places of the first and the last run have none."""
    runs = run_bins(series, by, [order], value).select(
        *by, F.col("start").cast("double").alias("low"), F.col("end").cast("double").alias("high"), F.col(value).cast("double").alias("mean")
    )
    slopes = edge_slopes(runs, by, kind)
    places = Window.partitionBy(*by).orderBy(order)
    placed = series.withColumn("_at", F.row_number().over(places) - 0.5)
    inside = [placed[c] == slopes[c] for c in by] + [(F.col("_at") > F.col("low")) & (F.col("_at") < F.col("high"))]
    met = placed.join(slopes, inside, "left")
    return met.select(*[placed[c] for c in series.columns], mean_preserving(F.col("_at")).alias("smooth"))


def triangles(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles of distinct points, by insertion (Bowyer and Watson, 1981); none of collinear ones."""
    n, size = len(points), float(np.ptp(points, axis=0).max()) or 1.0
    far = points.mean(axis=0) + size * np.array([[-1e4, -1e4], [1e4, -1e4], [0, 1.5e4]])
    p = np.vstack([points, far])

    def circle(t):
        a, b, c = p[list(t)]
        m = 2 * np.array([b - a, c - a])
        if abs(np.linalg.det(m)) < 1e-12:
            return None
        o = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        return o, (o - a) @ (o - a)

    found = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        bad = [t for t, k in found.items() if k is None or (p[i] - k[0]) @ (p[i] - k[0]) < k[1] * (1 - 1e-12)]
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                edges[e] = edges.get(e, 0) + 1
            del found[t]
        for (a, b), k in edges.items():
            if k == 1:
                t = tuple(sorted((a, b, i)))
                found[t] = circle(t)
    return [t for t, k in found.items() if max(t) < n and k is not None]


def fill_weights(have: np.ndarray, lack: np.ndarray) -> list[tuple[int, int, float]]:
    """Which of the points ``have`` fill each of ``lack``, and with what weights: the corners of the triangle that it is inside, or the nearest point
    outside all triangles or where points lie on a line."""
    out: list[tuple[int, int, float]] = []
    todo = np.ones(len(lack), bool)
    for t in triangles(have.astype(float)):
        a, b, c = have[list(t)].astype(float)
        w = (lack - a) @ np.linalg.inv(np.array([b - a, c - a]).T).T
        inside = np.flatnonzero(todo & (w >= -1e-9).all(1) & (w.sum(1) <= 1 + 1e-9))
        for i in inside.tolist():
            out += [(i, t[0], 1 - float(w[i].sum())), (i, t[1], float(w[i, 0])), (i, t[2], float(w[i, 1]))]
        todo[inside] = False
    for i in np.flatnonzero(todo).tolist():
        out.append((i, int(((lack[i] - have) ** 2).sum(-1).argmin()), 1.0))
    return out


def fill_grid(grid: np.ndarray) -> np.ndarray:
    """Zeros of ``grid`` filled linearly inside the points that aren't 0, by the nearest outside them or where they lie on a line."""
    have, lack = np.argwhere(grid != 0), np.argwhere(grid == 0)
    if not len(have) or not len(lack):
        return grid
    out = grid.copy()
    for i, k, w in fill_weights(have, lack):
        out[tuple(lack[i])] += w * grid[tuple(have[k])]
    return out


def fill_linear(offsets: DataFrame, *, by: Sequence[str] = ("frame",), row: str = "sub", col: str = "col", value: str = "value") -> DataFrame:
    """``offsets`` with zeros filled as ``fill_grid`` does. What fills a cell depends only on which cells are missing: weights are worked out once for each
    distinct mask, however many frames have it, and joined to the frames. A frame without values keeps its zeros."""
    rest = [c for c in offsets.columns if c not in by]
    frames = offsets.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), F.col(col).alias("c"), F.struct(*rest).alias("cell")))).alias("_s"))  # a frame's grid of bins
    low_r, low_c = F.array_min(F.transform("_s", lambda e: e["r"])), F.array_min(F.transform("_s", lambda e: e["c"]))
    frames = frames.withColumns({"_r0": low_r, "_c0": low_c})
    cells = F.transform("_s", lambda e: F.array(e["r"] - F.col("_r0"), e["c"] - F.col("_c0"), (e["cell"][value] != 0).cast("bigint")).cast("array<bigint>"))
    frames = frames.withColumn("_cells", cells).withColumn("_mask", F.sha2(F.to_json("_cells"), 256))
    masks = frames.groupBy("_mask").agg(F.first("_cells").alias("_cells"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cells in pdf["_cells"]:
                at = np.array([list(c) for c in cells], np.int64)
                have, lack = np.flatnonzero(at[:, 2]), np.flatnonzero(at[:, 2] == 0)
                k, w = [[] for _ in cells], [[] for _ in cells]
                for i, j, share in fill_weights(at[have, :2], at[lack, :2]) if len(have) and len(lack) else []:
                    k[lack[i]].append(int(have[j]))
                    w[lack[i]].append(share)
                out.append((k, w))
            yield pd.DataFrame({"_mask": pdf["_mask"], "_k": [k for k, _ in out], "_w": [w for _, w in out]})

    known = masks.mapInPandas(weigh, "_mask string, _k array<array<int>>, _w array<array<double>>")
    each = frames.join(known, "_mask").select(*by, "_s", F.posexplode(F.arrays_zip("_s", "_k", "_w")).alias("_i", "_e"))
    shares = F.zip_with("_e._k", "_e._w", lambda k, w: w * F.get("_s", k)["cell"][value])
    filled = F.when(F.size("_e._k") > 0, F.aggregate(shares, F.lit(0.0), lambda total, x: total + x))
    out = each.withColumn("_filled", filled).select(*by, "_e._s.cell.*", "_filled")
    return out.withColumn(value, F.coalesce("_filled", value)).select(*offsets.columns)


def fill_nearest(offsets: DataFrame, *, by: Sequence[str] = ("frame",), row: str = "sub", col: str = "col", value: str = "value") -> DataFrame:
    """``offsets`` with zeros replaced by the nearest value of their frame that isn't 0; of equally near ones, the first by row and column. Frames
    without one, or without zeros, are unchanged. A frame has as many offsets as the instrument has chunks."""
    have = offsets.where(F.col(value) != 0).select(*by, F.col(row).alias("_r"), F.col(col).alias("_c"), F.col(value).alias("_v"))
    away = (F.col(row) - F.col("_r")) ** 2 + (F.col(col) - F.col("_c")) ** 2
    got = offsets.where(F.col(value) == 0).join(have, list(by)).groupBy(*by, row, col).agg(F.min_by("_v", F.struct(away, "_r", "_c")).alias("_v"))
    return offsets.join(got, [*by, row, col], "left").withColumn(value, F.coalesce("_v", value)).drop("_v")
