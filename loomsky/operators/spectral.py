"""Spectral operators: interpolation in a cube, histograms, wavelength edges and the fit of arcs to them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Store


def cube(maps: DataFrame, *, keys: Sequence[str] = ("ref_y", "ref_x"), layer: str = "layer") -> DataFrame:
    """``keys, data, wave``: each pixel's layers (``layer, value, wave``) as arrays in order. A pixel has as many rows as there are channels."""
    layers = F.sort_array(F.collect_list(F.struct(layer, "value", "wave")))
    return maps.groupBy(*keys).agg(layers.alias("l")).select(*keys, F.col("l.value").alias("data"), F.col("l.wave").alias("wave"))


def at_wavelength(data: Column, wave: Column, target: Column) -> Column:
    """A spectrum, linear between the layers that bracket ``target``: the first at or above it and the one before. Below the first layer
    and above the last, the ends' lines go on; where the two aren't in order, the lower layer's value."""
    first = F.array_position(F.transform(wave, lambda w: w >= target), F.lit(True))
    hi = F.greatest(F.lit(2).cast("bigint"), F.least(F.when(first == 0, F.size(wave)).otherwise(first), F.size(wave).cast("bigint"))).cast("int")
    x0, x1, y0, y1 = F.element_at(wave, hi - 1), F.element_at(wave, hi), F.element_at(data, hi - 1), F.element_at(data, hi)
    return F.when(x1 - x0 > 0, y0 + (y1 - y0) * ((target - x0) / F.when(x1 - x0 > 0, x1 - x0))).otherwise(y0)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *, by: Sequence[str] = ()) -> DataFrame:
    """``by, bin, n, density`` over equal bins from ``low`` to ``high``; the last holds its right edge. Bins without rows are left out."""
    width = (high - low) / bins
    place = F.when(F.col(value) == high, bins - 1).otherwise(F.floor((F.col(value) - low) / width)).cast("bigint")
    counts = df.where(F.col(value).between(low, high)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    joined = counts.join(total, list(by)) if by else counts.join(F.broadcast(total))
    return joined.select(*by, "bin", "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


def edge_rows(band: DataFrame, edges: DataFrame, *, y: str = "det_y", x: str = "det_x", wave: str = "bc", edge: str = "edge") -> DataFrame:
    """``edge, x, y``: for each wavelength edge and column the row whose wavelength is nearest; of equally near ones the first. The edges
    are a table of the instrument. Cells without a wavelength don't count.

    Cells and edges of a column are sorted together, so an edge looks at the wavelengths before and after it only, not at every cell."""
    w = F.col(wave)
    cells = band.where(w.isNotNull() & ~F.isnan(w.cast("double"))).groupBy(x, w.alias("_w")).agg(F.min(y).alias("_y"))
    sought = cells.select(x).distinct().join(F.broadcast(edges.select(edge).distinct()))
    cell = F.struct(F.col("_w").alias("w"), F.col("_y").alias("y"))
    both = cells.select(x, "_w", F.lit(0).alias("_kind"), cell.alias("_cell"), F.lit(None).cast(edges.schema[edge].dataType).alias(edge)).unionByName(
        sought.select(x, F.col(edge).alias("_w"), F.lit(1).alias("_kind"), F.lit(None).cast(cells.select(cell.alias("c")).schema["c"].dataType).alias("_cell"), edge)
    )
    up, down = (Window.partitionBy(x).orderBy(o, "_kind").rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_w"), F.desc("_w")))
    ends = [F.last("_cell", ignorenulls=True).over(o) for o in (up, down)]
    near = both.withColumns({"_before": ends[0], "_after": ends[1]}).where("_kind = 1")
    far = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.w") - F.col(edge)).alias("d"), F.col(f"{c}.y").alias("y"))) for c in ("_before", "_after")]
    return near.select(edge, x, F.least(*far)["y"].alias(y))


def edge_samples(band: DataFrame, edges: DataFrame, *, size: int, margin: int = 650, y: str = "det_y", x: str = "det_x", wave: str = "bc", edge: str = "edge") -> DataFrame:
    """``edge_rows`` of a detector ``size`` cells wide, without the middle of the greatest edge: its columns over ``margin`` and below ``size - margin``."""
    last = edges.agg(F.max(edge).alias("_last"))
    found = edge_rows(band, edges, y=y, x=x, wave=wave, edge=edge).join(F.broadcast(last))
    middle = (F.col(edge) == F.col("_last")) & (F.col(x) > margin) & (F.col(x) < size - margin)
    return found.where(~middle).drop("_last")


def channel_edges(table: DataFrame, band: int) -> list[float]:
    """Lower ends of a band's channels in order, and the upper end of the last."""
    rows = table.where(F.col("band") == band).select("lmin", "lmax").orderBy("lmin").collect()  # 17 channels
    return [r.lmin for r in rows] + [rows[-1].lmax] if rows else []


def circle_sums(points: DataFrame, *, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """What an algebraic fit of a circle needs of the points: counts and sums of products up to the third order."""
    px, py = F.col(x), F.col(y)
    z = px * px + py * py
    terms = {"n": F.lit(1), "sx": px, "sy": py, "sz": z, "sxx": px * px, "sxy": px * py, "syy": py * py, "sxz": px * z, "syz": py * z}
    return points.groupBy(*by).agg(*[F.sum(t).alias(k) for k, t in terms.items()])


def kasa(sums: DataFrame) -> DataFrame:
    """Centre and radius of the algebraic circle fit (Kasa, 1976): ``xc, yc, radius``, null where the points lie on a line."""
    s = {c: F.col(c).cast("double") for c in ("n", "sx", "sy", "sz", "sxx", "sxy", "syy", "sxz", "syz")}
    # 2 xc x + 2 yc y + c = x x + y y, about the mean
    cxx, cxy, cyy = s["sxx"] - s["sx"] * s["sx"] / s["n"], s["sxy"] - s["sx"] * s["sy"] / s["n"], s["syy"] - s["sy"] * s["sy"] / s["n"]
    cxz, cyz = s["sxz"] - s["sx"] * s["sz"] / s["n"], s["syz"] - s["sy"] * s["sz"] / s["n"]
    det = 2 * (cxx * cyy - cxy * cxy)
    det = F.when(F.abs(det) > 1e-9, det)
    xc, yc = (cxz * cyy - cyz * cxy) / det, (cyz * cxx - cxz * cxy) / det
    out = sums.withColumns({"xc": xc, "yc": yc})
    c = (s["sz"] - 2 * F.col("xc") * s["sx"] - 2 * F.col("yc") * s["sy"]) / s["n"]
    return out.withColumn("radius", F.sqrt(F.greatest(c + F.col("xc") ** 2 + F.col("yc") ** 2, F.lit(0.0))))


def _round_sums(x: Column, y: Column, xc: Column, yc: Column) -> dict[str, Column]:
    """What a round of a geometric fit needs of points about (xc, yc): counts and sums of the distances, of the directions from them and of products."""
    dx, dy = xc - x, yc - y
    d = F.sqrt(dx * dx + dy * dy)
    u, v = F.when(d > 0, dx / d).otherwise(0.0), F.when(d > 0, dy / d).otherwise(0.0)
    terms = {"d": d, "u": u, "v": v, "dd": d * d, "uu": u * u, "uv": u * v, "vv": v * v, "ud": u * d, "vd": v * d}
    return {"n": F.count("*")} | {f"s{k}": F.sum(t) for k, t in terms.items()}


#: of Levenberg and Marquardt's damping: at the start, what a step that helps or doesn't multiplies it by, and where it gives up
DAMPING, EASED, RAISED, HOPELESS = 1e-3, 0.1, 10.0, 1e12


def fit_circles(points: DataFrame, *, by: Sequence[str], x: str = "x", y: str = "y", rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``by, xc, yc, radius, rms, converged``: for each group the circle with the least squares of distances to its points, by Levenberg and Marquardt's
    method from the algebraic circle, which is biased where arcs are short and noisy.

    At a given centre the best radius is the mean distance. So a round needs of each group ten sums at the centre on trial; groups are as many as sums, and
    their state, a row each, is written to the shared folder in each round. Groups that have settled aren't summed again. A group whose points lie on a line, or are fewer than
    three, is null and not converged, as is the flag of one that hasn't settled after ``rounds``. Points without a place or a group don't count."""
    own = F.lit(True)
    for c in (x, y):
        own &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    for c in by:
        own &= F.col(c).isNotNull()
    points = points.where(own).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).persist()
    store = Store(points.sparkSession)
    try:
        # about the points' mean, so that large coordinates lose no digits
        means = points.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
        means = store.keep(means, "means")
        few = F.broadcast if means.count() <= 1_000_000 else lambda df: df
        moved = points.join(few(means), list(by)).withColumns({"_x": F.col("_x") - F.col("_mx"), "_y": F.col("_y") - F.col("_my")}).drop("_mx", "_my")
        first = kasa(circle_sums(moved, x="_x", y="_y", by=by))
        none = F.lit(None).cast("double")
        state = first.select(*by, F.col("n").alias("_n"), F.when(F.col("n") >= 3, F.col("xc")).alias("tx"), F.when(F.col("n") >= 3, F.col("yc")).alias("ty"), *[none.alias(c) for c in _STATE], F.lit(DAMPING).alias("damp"))
        state = store.keep(state.withColumn("done", F.col("tx").isNull()).withColumn("converged", F.lit(False)), "state")
        for _ in range(rounds):
            trial = few(state.where("not done").select(*by, "tx", "ty"))
            sums = moved.join(trial, list(by)).groupBy(*by).agg(*[c.alias(k) for k, c in _round_sums(F.col("_x"), F.col("_y"), F.col("tx"), F.col("ty")).items()])
            state = store.keep(_tried(state.join(few(sums), list(by), "left"), tolerance).select(state.columns), "state")
            if state.where("not done").isEmpty():
                break
        out = state.join(few(means), list(by)).select(
            *by, (F.col("xc") + F.col("_mx")).alias("xc"), (F.col("yc") + F.col("_my")).alias("yc"), F.col("r").alias("radius"), F.sqrt(F.greatest(F.col("cost"), F.lit(0.0)) / F.col("_n")).alias("rms"), "converged",
        )
        return store.keep(out)
    finally:
        points.unpersist()
        store.drop("means", "state")


#: of a group: its centre so far, with the radius, the cost and the normal equations there
_STATE = ("xc", "yc", "r", "cost", "auu", "auv", "avv", "gu", "gv")


def _tried(met: DataFrame, tolerance: float) -> DataFrame:
    """Groups after a trial: it is taken where it costs no more, and the next one is found with less damping, otherwise with more."""
    c, n = F.col, F.col("n")
    met = met.withColumns({
        "_r": c("sd") / n, "_cost": c("sdd") - c("sd") * c("sd") / n, "_auu": c("suu") - c("su") * c("su") / n, "_auv": c("suv") - c("su") * c("sv") / n,
        "_avv": c("svv") - c("sv") * c("sv") / n, "_gu": c("sud") - c("su") * c("sd") / n, "_gv": c("svd") - c("sv") * c("sd") / n,
    })
    active = ~c("done")
    better = active & (c("cost").isNull() | (c("_cost") <= c("cost")))
    new = {"xc": c("tx"), "yc": c("ty"), **{k: c(f"_{k}") for k in _STATE[2:]}}
    first = c("cost").isNull()
    met = met.withColumns({"_better": better, "_first": first, "_step": F.greatest(F.abs(c("tx") - c("xc")), F.abs(c("ty") - c("yc")))})
    met = met.withColumns({k: F.when(c("_better"), v).otherwise(c(k)) for k, v in new.items()} | {
        "damp": F.when(c("done") | c("_first"), c("damp")).when(c("_better"), c("damp") * EASED).otherwise(c("damp") * RAISED),
    })
    a, d, b = c("auu") * (1 + c("damp")), c("avv") * (1 + c("damp")), c("auv")
    det = F.when(a * d - b * b > 0, a * d - b * b)
    met = met.withColumns({"_su": (b * c("gv") - d * c("gu")) / det, "_sv": (b * c("gu") - a * c("gv")) / det})
    size = F.greatest(F.lit(1.0), F.abs(c("xc")), F.abs(c("yc")))
    still = F.greatest(F.abs(c("_su")), F.abs(c("_sv"))) <= tolerance * size
    settled = F.coalesce(still, F.lit(False))
    stuck = c("_su").isNull() | (c("damp") > HOPELESS)
    return met.withColumns({
        "converged": c("converged") | (active & settled), "tx": F.when(active, c("xc") + c("_su")).otherwise(c("tx")), "ty": F.when(active, c("yc") + c("_sv")).otherwise(c("ty")),
        "done": c("done") | settled | stuck,
    })


def fit_arcs(points: DataFrame, start: tuple[float, float], *, edge: str = "edge", x: str = "x", y: str = "y", rounds: int = 100, tolerance: float = 1e-10):
    """One centre for the arcs of all edges, and a radius for each: ((xc, yc), {edge: radius}), by Levenberg and Marquardt's method, so that a start may be far off.

    At a given centre the best radius of an edge is the mean distance of its points. So a round needs of each edge ten sums about the centre on trial, which
    is all that leaves Spark. It's an error if the centre doesn't settle."""
    points = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).persist()
    (xc, yc), damp, cost, trial = start, DAMPING, None, start
    try:
        for _ in range(rounds):
            terms = _round_sums(F.col(x), F.col(y), F.lit(float(trial[0])), F.lit(float(trial[1])))
            rows = points.groupBy(edge).agg(*[t.alias(k) for k, t in terms.items()]).collect()  # the edges
            if not rows:
                raise ValueError("no points to fit")
            tried = sum(r.sdd - r.sd * r.sd / r.n for r in rows)
            if cost is None or tried <= cost:
                damp = damp if cost is None else damp * EASED
                (xc, yc), cost = trial, tried
                radii = {r[edge]: r.sd / r.n for r in rows}
                a = sum(np.array([[r.suu - r.su * r.su / r.n, r.suv - r.su * r.sv / r.n], [r.suv - r.su * r.sv / r.n, r.svv - r.sv * r.sv / r.n]]) for r in rows)
                g = sum(np.array([r.sud - r.su * r.sd / r.n, r.svd - r.sv * r.sd / r.n]) for r in rows)
            else:
                damp *= RAISED
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a)), -g, rcond=None)[0]
            if np.abs(step).max() <= tolerance * max(1.0, abs(xc), abs(yc)):
                return (float(xc), float(yc)), radii
            if damp > HOPELESS:
                break
            trial = (xc + step[0], yc + step[1])
        raise RuntimeError(f"the arcs' centre did not settle in {rounds} rounds")
    finally:
        points.unpersist()


def fit_lvf(band: DataFrame, edges: DataFrame, start: tuple[float, float], *, size: int, margin: int = 650, **names: str) -> dict[str, object]:
    """Parameters of a linear variable filter, ``xc, yc, R, wave_edges``: the arcs fitted to the samples of its edges, radii in the order of the edges."""
    (xc, yc), radii = fit_arcs(edge_samples(band, edges, size=size, margin=margin, **names), start, x=names.get("x", "det_x"), y=names.get("y", "det_y"), edge=names.get("edge", "edge"))
    order = sorted(radii)
    return {"xc": xc, "yc": yc, "R": [radii[e] for e in order], "wave_edges": order}
