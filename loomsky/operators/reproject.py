"""Reprojection of exposures onto the reference frame: bilinear, exact by areas of overlap, or adaptive by a kernel of the mapping's shape.

The detector's and the reference frame's planes are tangent planes, so what takes a pixel of one to the other is a homography: three linear forms
and two divisions, with no angles. Each exposure's is worked out once. A detector pixel then gives to the reference pixels about it that need it, all in
column expressions, and one aggregation by reference pixel adds up: nothing is joined but a row for each exposure.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distortion import Sip
from ..functions.geometry import Frame, from_plane, plane
from . import tiles

#: bytes of exposures' rows, counted first, up to which they are broadcast
SMALL = 64 << 20
#: areas of overlap under this part of a pixel are rounding
SLIVER = 1e-9
#: of the adaptive kernel: where its Gaussian falls to exp(-2), and where it ends, in pixels of the larger of the two rasters
KERNEL_WIDTH, KERNEL_REACH = 1.3, 2.0

Matrix = list[list[Column]]


def _apply(cd: tuple[str, str, str, str], a: Column, b: Column) -> tuple[Column, Column]:
    m = [F.col(c) for c in cd]
    return m[0] * a + m[1] * b, m[2] * a + m[3] * b


def to_reference(pixels: DataFrame, frame: Frame, *, y: str = "det_y", x: str = "det_x", out: tuple[str, str] = ("ref_fy", "ref_fx"), sip: Sip | None = None) -> DataFrame:
    """Detector places in reference pixels. ``pixels`` have their exposure's ``ra0, dec0, px, py, cd11, cd12, cd21, cd22`` (px, py: the pixel at ra0, dec0);
    ``sip`` is their detector's distortion."""
    u, v = F.col(x) - F.col("px"), F.col(y) - F.col("py")
    xi, eta = _apply(("cd11", "cd12", "cd21", "cd22"), *(sip.undistorted(u, v) if sip else (u, v)))
    ra, dec = from_plane(xi, eta, F.col("ra0"), F.col("dec0"))
    fx, fy = frame.pixel(ra, dec)
    return pixels.withColumns({out[0]: fy, out[1]: fx})


def to_detector(targets: DataFrame, frame: Frame, *, y: str = "ref_y", x: str = "ref_x", out: tuple[str, str] = ("map_y", "map_x"), sip: Sip | None = None) -> DataFrame:
    """Reference pixels in detector places, the inverse of ``to_reference``."""
    ra, dec = frame.sky(F.col(x), F.col(y))
    xi, eta = plane(ra, dec, F.col("ra0"), F.col("dec0"))
    det = F.col("cd11") * F.col("cd22") - F.col("cd12") * F.col("cd21")
    dx = (F.col("cd22") * xi - F.col("cd12") * eta) / det
    dy = (F.col("cd11") * eta - F.col("cd21") * xi) / det
    if sip:
        dx, dy = sip.distorted(dx, dy)
    return targets.withColumns({out[0]: dy + F.col("py"), out[1]: dx + F.col("px")})


def _turned(frame: Frame) -> list[list[Column]]:
    """The rows east, north and outward of the reference frame's axes in those of an exposure. From differences of angles, so that what coincides gives ones and zeros exactly."""
    ra, dec = frame.crval
    north, turn, d1, d2 = F.radians(F.col("dec0") - dec), F.radians(F.col("ra0") - ra), F.radians("dec0"), math.radians(dec)
    less = 2 * F.sin(turn / 2) * F.sin(turn / 2)  # 1 - cos
    return [
        [F.cos(turn), -F.sin(d1) * F.sin(turn), F.cos(d1) * F.sin(turn)],
        [math.sin(d2) * F.sin(turn), F.cos(north) - F.sin(d1) * math.sin(d2) * less, F.sin(north) + math.sin(d2) * F.cos(d1) * less],
        [-math.cos(d2) * F.sin(turn), math.cos(d2) * F.sin(d1) * less - F.sin(north), F.cos(north) - F.cos(d1) * math.cos(d2) * less],
    ]


def _solved(cd: tuple[tuple[float, float], tuple[float, float]], right: tuple[Column, Column]) -> tuple[Column, Column]:
    """(x, y) with cd (x, y) = ``right``, by elimination: a diagonal is divided by, and no more."""
    (a, b), (c, d) = cd
    one, two = right
    if abs(c) > abs(a):
        a, b, c, d, one, two = c, d, a, b, two, one
    y = (two - one * (c / a)) / (d - c / a * b)
    return (one - y * b) / a, y


def placements(exposures: DataFrame, frame: Frame, width: int | None = None) -> DataFrame:
    """``frame``, the homography from reference pixels to detector pixels ``h0`` to ``h8``, its inverse ``g0`` to ``g8``, and the first pixels
    ``_oy, _ox`` of the square of ``width`` about the exposure's centre. ``k0`` to ``k8`` and ``l0`` to ``l8`` are the same two, but with reference pixels counted
    from ``crpix`` and detector pixels from ``px, py``: these don't lose digits far from the raster's first pixel."""
    x0, y0 = frame.crpix[0] - 1, frame.crpix[1] - 1
    scale = 180 / math.pi  # the sphere's radius, for the planes to be in degrees
    axes = _turned(frame)
    c = F.col
    cd = [[c("cd11"), c("cd12")], [c("cd21"), c("cd22")]]
    turned = {f"_m{i}{j}": axes[i][0] * cd[0][j] + axes[i][1] * cd[1][j] for i in range(3) for j in range(2)} | {f"_m{i}2": axes[i][2] * scale for i in range(3)}
    placed = exposures.withColumns(turned)
    forms = {}
    for j in range(3):
        forms[f"l{j}"], forms[f"l{3 + j}"] = _solved(frame.cd, (c(f"_m0{j}"), c(f"_m1{j}")))
        forms[f"l{6 + j}"] = c(f"_m2{j}") / scale
    placed = placed.withColumns(forms)
    m = _matrix("l")
    # cofactors, not divided: a scale of the forms is of no account, but for its sign
    minor = [[m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]
    sign = F.signum(m[0][0] * minor[0][0] + m[0][1] * minor[1][0] + m[0][2] * minor[2][0])
    placed = placed.withColumns({f"k{3 * i + j}": sign * minor[i][j] for i in range(3) for j in range(3)})
    whole = {}
    for to, of, end_x, end_y, from_x, from_y in (("h", "k", c("px"), c("py"), F.lit(x0), F.lit(y0)), ("g", "l", F.lit(x0), F.lit(y0), c("px"), c("py"))):
        m = _matrix(of)
        rows = [[m[0][j] + end_x * m[2][j] for j in range(3)], [m[1][j] + end_y * m[2][j] for j in range(3)], m[2]]
        whole |= {f"{to}{3 * i + j}": rows[i][j] if j < 2 else rows[i][2] - from_x * rows[i][0] - from_y * rows[i][1] for i in range(3) for j in range(3)}
    cx, cy = frame.pixel(c("ra0"), c("dec0"))
    half = width // 2 if width else 0
    origin = [(cy - half).cast("int").alias("_oy"), (cx - half).cast("int").alias("_ox")]
    return placed.withColumns(whole).select("frame", *[f"{n}{i}" for n in "hgkl" for i in range(9)], c("px").alias("_ax"), c("py").alias("_ay"), *origin)


def _matrix(name: str) -> Matrix:
    return [[F.col(f"{name}{3 * i + j}") for j in range(3)] for i in range(3)]


def _anchors(frame: Frame, name: str) -> tuple[Column, Column, Column, Column]:
    """(y, x) that a homography (``k`` or ``l``) counts from, and those that it counts to."""
    ends = F.lit(frame.crpix[1] - 1), F.lit(frame.crpix[0] - 1), F.col("_ay"), F.col("_ax")
    return ends if name == "k" else (*ends[2:], *ends[:2])


def _mapped(df: DataFrame, frame: Frame, name: str, points: dict[tuple[str, str], tuple[Column, Column]]) -> DataFrame:
    """``df`` with places (y, x) taken through a homography (``k`` or ``l``), as columns of the names that ``points`` has for them; null beyond the horizon. The
    divisors come first, for each to be worked out once."""
    m = _matrix(name)
    from_y, from_x, to_y, to_x = _anchors(frame, name)
    points = {k: (y - from_y, x - from_x) for k, (y, x) in points.items()}
    divisors = {f"_over_{y}": m[2][0] * at_x + m[2][1] * at_y + m[2][2] for (y, _), (at_y, at_x) in points.items()}
    df = df.withColumns({k: F.when(w > 0, w) for k, w in divisors.items()})
    forms = {}
    for (y, x), (at_y, at_x) in points.items():
        forms[y] = to_y + (m[1][0] * at_x + m[1][1] * at_y + m[1][2]) / F.col(f"_over_{y}")
        forms[x] = to_x + (m[0][0] * at_x + m[0][1] * at_y + m[0][2]) / F.col(f"_over_{y}")
    return df.withColumns(forms)


def _derivatives(df: DataFrame, frame: Frame, name: str, y: str, x: str, out: Sequence[str]) -> DataFrame:
    """``df`` with dy'/dy, dy'/dx, dx'/dy, dx'/dx of a homography, as columns ``out``, where ``_mapped`` took a place to (``y``, ``x``)."""
    m, w = _matrix(name), F.col(f"_over_{y}")
    _, _, to_y, to_x = _anchors(frame, name)
    dy, dx = F.col(y) - to_y, F.col(x) - to_x
    return df.withColumns({
        out[0]: (m[1][1] - dy * m[2][1]) / w, out[1]: (m[1][0] - dy * m[2][0]) / w,
        out[2]: (m[0][1] - dx * m[2][1]) / w, out[3]: (m[0][0] - dx * m[2][0]) / w,
    })


def by_frame(pixels: DataFrame, rows: int = 100_000) -> DataFrame:
    """``pixels`` dealt by frame, some ``rows`` (counted now) to a task: for pixels that lie in no order, each of which would else give many partial sums to shuffle."""
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pixels.repartition(max(parts, -(-pixels.count() // rows)), "frame")


def _few(exposures: DataFrame, frame: Frame, width: int | None) -> DataFrame:
    """The exposures' placements, broadcast while they are few: then neither pixels nor targets are shuffled for them."""
    rows = placements(exposures, frame, width)
    rows = rows.drop(*[f"{n}{i}" for n in "hg" for i in range(9)])
    return F.broadcast(rows) if exposures.count() * 16 * len(rows.columns) <= SMALL else rows


def _about(placed: DataFrame, frame: Frame, width: int | None, y_from: Column, y_to: Column, x_from: Column, x_to: Column) -> DataFrame:
    """A row for each reference pixel from ``y_from`` to ``y_to`` and ``x_from`` to ``x_to``, inside the frame and the exposure's square."""
    low_y, low_x, high_y, high_x = F.lit(0), F.lit(0), F.lit(frame.ny - 1), F.lit(frame.nx - 1)
    if width:
        low_y, low_x = F.greatest(low_y, "_oy"), F.greatest(low_x, "_ox")
        high_y, high_x = F.least(high_y, F.col("_oy") + width - 1), F.least(high_x, F.col("_ox") + width - 1)
    box = placed.withColumns({
        "_y1": F.greatest(F.ceil(y_from), low_y), "_y2": F.least(F.floor(y_to), high_y), "_x1": F.greatest(F.ceil(x_from), low_x), "_x2": F.least(F.floor(x_to), high_x),
    })
    # no row for a null; a filter would be pushed below the join, with all that it needs
    rows = box.withColumn("ref_y", F.explode(F.when(F.expr("_y1 <= _y2 and _x1 <= _x2"), F.sequence("_y1", "_y2"))))
    return rows.withColumn("ref_x", F.explode(F.sequence("_x1", "_x2"))).drop("_y1", "_y2", "_x1", "_x2")


def _corners(placed: DataFrame, frame: Frame, reach: float) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``placed`` with the corners of a square of ``reach`` about each pixel, in reference pixels, and their columns' names, in order."""
    names = [(f"_qy{k}", f"_qx{k}") for k in range(4)]
    points = {n: (F.col("det_y") + reach * a, F.col("det_x") + reach * b) for n, (a, b) in zip(names, _CORNERS)}
    return _mapped(placed, frame, "l", points), names


_CORNERS = ((-1, -1), (-1, 1), (1, 1), (1, -1))


def _bilinear(placed: DataFrame, frame: Frame, width: int | None) -> DataFrame:
    """``placed`` pixels, a row for each reference pixel that interpolates with them, with their weight ``_w`` and the reference pixel's place ``_py, _px``.

    The box about a pixel is what the forms' bounds over the square of one pixel about it leave possible; where nothing is projective it is exact. A pixel that meets the horizon has none."""
    m = _matrix("l")
    y, x, to_y, to_x = _anchors(frame, "l")
    v, u = F.col("det_y") - y, F.col("det_x") - x
    middle = {f"_f{i}": m[i][0] * u + m[i][1] * v + m[i][2] for i in range(3)}
    room = {f"_e{i}": F.abs(m[i][0]) + F.abs(m[i][1]) for i in range(3)}
    box = placed.withColumns(middle | room)
    box = box.withColumns({"_least": F.col("_f2") - F.col("_e2"), "_most": F.col("_f2") + F.col("_e2")})
    box = box.withColumn("_least", F.when(F.col("_least") > 0, F.col("_least")))
    ends = {}
    for i in (0, 1):
        low, high = F.col(f"_f{i}") - F.col(f"_e{i}"), F.col(f"_f{i}") + F.col(f"_e{i}")
        ends |= {f"_from{i}": low / F.when(low < 0, F.col("_least")).otherwise(F.col("_most")), f"_to{i}": high / F.when(high < 0, F.col("_most")).otherwise(F.col("_least"))}
    box = box.withColumns(ends)
    near = _about(box, frame, width, to_y + F.col("_from1"), to_y + F.col("_to1"), to_x + F.col("_from0"), to_x + F.col("_to0"))
    near = _mapped(near, frame, "k", {("_py", "_px"): (F.col("ref_y"), F.col("ref_x"))})
    near = near.withColumns({"_v": 1 - F.abs(F.col("_py") - F.col("det_y")), "_u": 1 - F.abs(F.col("_px") - F.col("det_x"))})
    near = near.where(F.coalesce(F.expr("_v > 0 and _u > 0"), F.lit(False)))  # without coalesce, that no form is null would be asked of exposures
    return near.withColumn("_w", F.col("_v") * F.col("_u"))


_FOUR = ((0, 0), (0, 1), (1, 0), (1, 1))


def _word(dq: str) -> Column:
    return F.col(dq).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))


def _words(dq: str | None) -> list[Column]:
    """Aggregates of pixels beside a place ``_py, _px``: the flags of each of the four about it, as ``_dq0`` to ``_dq3``."""
    if not dq:
        return []
    y, x = F.col("det_y") - F.floor("_py"), F.col("det_x") - F.floor("_px")
    return [F.bit_or(F.when((y == a) & (x == b), _word(dq))).alias(f"_dq{k}") for k, (a, b) in enumerate(_FOUR)]


def _masks(placed: DataFrame, frame: Frame, width: int | None, dq: str, threshold: float) -> DataFrame:
    """``frame, ref_y, ref_x, dq`` where a flag's interpolated weight is over ``threshold``; only flags that are set make rows."""
    word = _word(dq)
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.getbit(word, b) == 1)
    flagged = _bilinear(placed.where(word != 0), frame, width).select("frame", "ref_y", "ref_x", "_w", F.explode(bits).alias("_bit"))
    heavy = flagged.groupBy("frame", "ref_y", "ref_x", "_bit").agg(F.sum("_w").alias("_w")).where(F.col("_w") > threshold)
    return heavy.groupBy("frame", "ref_y", "ref_x").agg(F.bit_or(F.pow(F.lit(2.0), "_bit").cast("bigint")).alias(dq))


def _finished(found: DataFrame, rows: DataFrame, frame: Frame, dq: str | None, threshold: float, masks: DataFrame | None = None) -> DataFrame:
    """``found`` with the detector's places and the mask: that of ``masks``, or else that of the four pixels about a place."""
    words = [f"_dq{k}" for k in range(4)] if dq and masks is None else []
    out = _mapped(found.join(rows, "frame"), frame, "k", {("map_y", "map_x"): (F.col("ref_y"), F.col("ref_x"))}).select(*found.columns, "map_y", "map_x")
    if words:
        fy, fx = F.col("map_y") - F.floor("map_y"), F.col("map_x") - F.floor("map_x")
        weights = [(fy if a else 1 - fy) * (fx if b else 1 - fx) for a, b in _FOUR]
        out = out.withColumn(dq, tiles.heavy_bits([F.coalesce(w, F.lit(0).cast("bigint")) for w in words], weights, threshold)).drop(*words)
    if masks is not None:
        out = out.join(masks, ["frame", "ref_y", "ref_x"], "left").withColumn(dq, F.coalesce(dq, F.lit(0).cast("bigint")))
    return out


def interpolated(
    exposures: DataFrame, pixels: DataFrame, frame: Frame, width: int | None = None, *, values: tuple[str, ...] = ("value",), dq: str | None = "dq", threshold: float = 0.01
) -> DataFrame:
    """``frame, ref_y, ref_x, values, foot, map_y, map_x, dq`` by bilinear interpolation; pixels outside the detector, or outside a square of ``width``
    about the exposure's centre, are left out.

    ``exposures`` are as ``to_reference`` says, with ``frame``; ``pixels`` are ``frame, det_y, det_x`` and the values and masks. ``foot`` is the weight of
    the detector pixels that there are, of 1. Pixels without a column ``dq`` give no masks. A mask's bit is set where the weight of flagged cells is over ``threshold``. A value that is NaN makes all NaN that it
    has weight in. Pixels that come dealt by ``frame`` (``by_frame``) aren't shuffled again, nor are sums."""
    dq = dq if dq in pixels.columns else None
    rows = _few(exposures, frame, width)
    placed = pixels.join(rows, "frame")
    parts = _bilinear(placed, frame, width)
    found = parts.groupBy("frame", "ref_y", "ref_x").agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values], F.sum("_w").alias("foot"), *_words(dq))
    return _finished(found, rows, frame, dq, threshold)


def with_overlap(df: DataFrame, quad: Sequence[tuple[str, str]], name: str = "_a") -> DataFrame:
    """``df`` with the area of a quadrilateral, corners (y, x) in order, inside the cell about (``ref_y, ref_x``): under each edge, cut to the cell's
    width, the mean height over the cell's floor, held between floor and ceiling. In steps, for each to be worked out once."""
    one, zero = F.lit(1.0), F.lit(0.0)

    def inside(v: Column) -> Column:
        return F.least(F.greatest(v, zero), one)

    floor, left = F.col("ref_y") - 0.5, F.col("ref_x") - 0.5
    edges = list(enumerate(zip(quad, [*quad[1:], quad[0]])))
    c = F.col
    df = df.withColumns({f"_l{k}": inside(c(x) - left) for k, (_, x) in enumerate(quad)})
    ends = {k: (f"_l{k}", f"_l{(k + 1) % len(quad)}") for k, _ in edges}
    df = df.withColumns({f"_t{k}": F.try_divide(c(q[0]) - c(p[0]), c(q[1]) - c(p[1])) for k, (p, q) in edges})
    df = df.withColumns({f"_v{k}{e}": c(p[0]) - floor + (c(ends[k][e]) + left - c(p[1])) * c(f"_t{k}") for k, (p, _) in edges for e in (0, 1)})
    df = df.withColumns({f"_n{k}": F.least(f"_v{k}0", f"_v{k}1") for k, _ in edges} | {f"_m{k}": F.greatest(f"_v{k}0", f"_v{k}1") for k, _ in edges})
    df = df.withColumns({f"_i{k}": inside(c(f"_n{k}")) for k, _ in edges} | {f"_j{k}": inside(c(f"_m{k}")) for k, _ in edges})
    total = zero
    for k, _ in edges:
        low, high, a, b = c(f"_n{k}"), c(f"_m{k}"), c(f"_i{k}"), c(f"_j{k}")
        over = F.greatest(high - F.greatest(low, one), zero)
        mean = F.when(high - low < 1e-12, a).otherwise(((b - a) * (a + b) / 2 + over) / (high - low))
        total = total + F.when(c(ends[k][0]) == c(ends[k][1]), zero).otherwise((c(ends[k][1]) - c(ends[k][0])) * mean)
    return df.withColumn(name, F.abs(total))


def exact(
    exposures: DataFrame, pixels: DataFrame, frame: Frame, width: int | None = None, *, values: tuple[str, ...] = ("value",), dq: str | None = "dq", threshold: float = 0.01
) -> DataFrame:
    """As ``interpolated``, the values being means of the detector pixels weighed by their areas in each reference pixel; ``foot`` is the area covered. Masks
    are interpolated."""
    dq = dq if dq in pixels.columns else None
    rows = _few(exposures, frame, width)
    placed = pixels.join(rows, "frame")
    placed_at, quad = _corners(placed, frame, 0.5)
    ys, xs = zip(*quad)
    near = _about(placed_at, frame, width, F.least(*ys) - 0.5, F.greatest(*ys) + 0.5, F.least(*xs) - 0.5, F.greatest(*xs) + 0.5)
    near = with_overlap(near, quad).select("frame", "ref_y", "ref_x", "_a", *values)
    # a filter before the sums would be pushed below the steps, and work them all out again
    means = [F.try_divide(F.sum(F.when(F.col("_a") > SLIVER, F.col("_a") * F.col(v))), F.sum("_a")).alias(v) for v in values]
    found = near.groupBy("frame", "ref_y", "ref_x").agg(*means, F.sum("_a").alias("foot")).where(F.col("foot") > SLIVER)
    return _finished(found, rows, frame, dq, threshold, _masks(placed, frame, width, dq, threshold) if dq else None)


def adaptive(
    exposures: DataFrame, pixels: DataFrame, frame: Frame, width: int | None = None, *, values: tuple[str, ...] = ("value",), dq: str | None = "dq", threshold: float = 0.01,
    conserve_flux: bool = False, least_foot: float = 0.5,
) -> DataFrame:
    """As ``interpolated``, the values being means under a Gaussian of the shape that a reference pixel has on the detector (DeForest, 2004).

    The shape is the mapping's Jacobian with singular values under 1 taken as 1, so that no kernel is smaller than a pixel of either raster. The
    Gaussian falls to exp(-2) at 1.3 pixels and ends at 2. ``foot`` is the part of the kernel that lies on detector pixels; below ``least_foot`` there is no
    row. ``conserve_flux`` multiplies by the area of a reference pixel in detector pixels, so that sums of pixels are kept, not their mean."""
    dq = dq if dq in pixels.columns else None
    rows = _few(exposures, frame, width)
    placed = pixels.join(rows, "frame")
    box = _mapped(placed, frame, "l", {("_cy", "_cx"): (F.col("det_y"), F.col("det_x"))})
    box = _derivatives(box, frame, "l", "_cy", "_cx", ("_gyy", "_gyx", "_gxy", "_gxx"))
    # the kernel's half height and width in reference pixels are at most these, and some room for the mapping's change over it: a singular value
    # of 1 or more on the detector takes its own part of the reference pixel, one below it takes 1
    yy, yx, xy, xx = (F.col(f"_g{v}") for v in ("yy", "yx", "xy", "xx"))
    box = box.withColumns({"_p": yy * yy + yx * yx, "_q": yy * xy + yx * xx, "_r": xy * xy + xx * xx})
    p, q, r = (F.col(v) for v in ("_p", "_q", "_r"))
    box = box.withColumn("_rad", (p + r) / 2 + F.sqrt((p - r) * (p - r) / 4 + q * q))
    box = box.withColumn("_less", F.greatest(1 - 1 / F.col("_rad"), F.lit(0.0)))
    box = box.withColumns({f"_reach_{v}": KERNEL_REACH * 1.02 * F.sqrt(1 + F.col("_less") * c) for v, c in (("y", p), ("x", r))}).drop("_p", "_q", "_r", "_rad", "_less")
    near = _about(box, frame, width, *[F.col(f"_c{v}") + s * F.col(f"_reach_{v}") for v in ("y", "x") for s in (-1, 1)])
    near = _mapped(near, frame, "k", {("_py", "_px"): (F.col("ref_y"), F.col("ref_x"))})
    near = _derivatives(near, frame, "k", "_py", "_px", ("_yy", "_yx", "_xy", "_xx"))
    yy, yx, xy, xx = (F.col(v) for v in ("_yy", "_yx", "_xy", "_xx"))
    # J J' has the squared singular values; 1 / max(1, .) of it is a I + b J J'
    near = near.withColumns({"_p": yy * yy + yx * yx, "_q": yy * xy + yx * xx, "_r": xy * xy + xx * xx})
    p, q, r = (F.col(v) for v in ("_p", "_q", "_r"))
    near = near.withColumn("_rad", F.sqrt((p - r) * (p - r) / 4 + q * q))
    big, little = (p + r) / 2 + F.col("_rad"), (p + r) / 2 - F.col("_rad")
    near = near.withColumns({"_big": F.greatest(big, F.lit(1.0)), "_little": F.greatest(little, F.lit(1.0))})
    slope = F.when(F.col("_rad") > 1e-12 * big, (1 / F.col("_big") - 1 / F.col("_little")) / (2 * F.col("_rad"))).otherwise(0.0)
    dy, dx = F.col("_py") - F.col("det_y"), F.col("_px") - F.col("det_x")
    near = near.withColumns({"_m": slope, "_dy": dy, "_dx": dx})
    dy, dx = F.col("_dy"), F.col("_dx")
    far = (1 / F.col("_big") - F.col("_m") * big) * (dy * dy + dx * dx) + F.col("_m") * (dy * dy * p + 2 * dy * dx * q + dx * dx * r)
    near = near.withColumn("_far", far)
    whole = math.pi * KERNEL_WIDTH**2 / 2 * (1 - math.exp(-2 * KERNEL_REACH**2 / KERNEL_WIDTH**2))
    flags = ["det_y", "det_x", "_py", "_px", dq] if dq else []
    near = near.select(
        "frame", "ref_y", "ref_x", *values, *flags, F.when(F.col("_far") <= KERNEL_REACH**2, F.exp(F.col("_far") * (-2 / KERNEL_WIDTH**2))).alias("_w"), (whole * F.sqrt(F.col("_big") * F.col("_little"))).alias("_whole"),
        F.abs(yy * xx - yx * xy).alias("_area"),
    )
    scale = F.first("_area") if conserve_flux else F.lit(1.0)
    means = [(F.sum(F.col("_w") * F.col(v)) / F.sum("_w") * scale).alias(v) for v in values]
    found = near.groupBy("frame", "ref_y", "ref_x").agg(*means, (F.sum("_w") / F.first("_whole")).alias("foot"), *_words(dq)).where(F.col("foot") >= least_foot)
    return _finished(found, rows, frame, dq, threshold)


METHODS = {"interp": interpolated, "exact": exact, "adaptive": adaptive}
