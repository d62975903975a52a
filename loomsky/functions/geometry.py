"""Geometry on the sphere and in the tangent plane: column expressions and driver-side reference frames. Angles in degrees."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distortion import Sip


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance, by haversines."""
    a1, d1, a2, d2 = (F.radians(c) for c in (ra1, dec1, ra2, dec2))
    h = F.sin((d2 - d1) / 2) ** 2 + F.cos(d1) * F.cos(d2) * F.sin((a2 - a1) / 2) ** 2
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def cone(df: DataFrame, ra: float, dec: float, radius: float, *, ra_col: str = "ra", dec_col: str = "dec") -> DataFrame:
    """Rows strictly within ``radius``. The declination band, a plain range, reaches the scan; the distance is taken of what it leaves."""
    band = F.col(dec_col).between(dec - radius, dec + radius)
    return df.where(band).where(separation(F.col(ra_col), F.col(dec_col), F.lit(ra), F.lit(dec)) < radius)


@dataclass(frozen=True)
class Frame:
    """A tangent-plane frame: pixel centres count from 0, ``crpix`` from 1, as in its header. With ``sip``, of a distorted detector."""

    crval: tuple[float, float]
    crpix: tuple[float, float]
    cd: tuple[tuple[float, float], tuple[float, float]]
    ny: int
    nx: int
    sip: Sip | None = None

    def padded(self, pad: int) -> Frame:
        """Larger by ``pad`` pixels on each side."""
        return replace(self, crpix=(self.crpix[0] + pad, self.crpix[1] + pad), ny=self.ny + 2 * pad, nx=self.nx + 2 * pad)

    def upscaled(self, f: float) -> Frame:
        """Pixels smaller by ``f``; crpix is scaled without a half-pixel shift."""
        cd = tuple(tuple(v / f for v in row) for row in self.cd)
        return replace(self, crpix=(self.crpix[0] * f, self.crpix[1] * f), cd=cd, ny=round(self.ny * f), nx=round(self.nx * f), sip=self.sip and self.sip.scaled(f))

    def cropped(self, y_min: int, x_min: int, ny: int, nx: int) -> Frame:
        """The part that begins at a pixel of this frame."""
        return replace(self, crpix=(self.crpix[0] - x_min, self.crpix[1] - y_min), ny=ny, nx=nx)

    def pixel(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        """(x, y) of a place on the sky."""
        xi, eta = plane(ra, dec, *self.crval)
        (a, b), (c, d) = self.cd
        det = a * d - b * c
        u, v = (d * xi - b * eta) / det, (a * eta - c * xi) / det
        if self.sip:
            u, v = self.sip.distorted(u, v)
        return u + (self.crpix[0] - 1), v + (self.crpix[1] - 1)

    def sky(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(ra, dec) of a pixel."""
        dx, dy = x - (self.crpix[0] - 1), y - (self.crpix[1] - 1)
        if self.sip:
            dx, dy = self.sip.undistorted(dx, dy)
        (a, b), (c, d) = self.cd
        return from_plane(a * dx + b * dy, c * dx + d * dy, *self.crval)


def map_pixels(x: Column, y: Column, source: Frame, target: Frame) -> tuple[Column, Column]:
    """A pixel of one frame in another's pixels, distorted or not."""
    return target.pixel(*source.sky(x, y))


def plane(ra: Column, dec: Column, ra0: float | Column, dec0: float | Column) -> tuple[Column, Column]:
    """Gnomonic (TAN) coordinates about (ra0, dec0); null on the far half of the sphere."""
    ra0, dec0 = (F.lit(v) if not isinstance(v, Column) else v for v in (ra0, dec0))
    da, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    cos = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(da)
    near = F.when(cos > 0, cos)
    xi = F.cos(d) * F.sin(da) / near
    eta = (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da)) / near
    return F.degrees(xi), F.degrees(eta)


def from_plane(xi: Column, eta: Column, ra0: float | Column, dec0: float | Column) -> tuple[Column, Column]:
    """The inverse of ``plane``."""
    ra0, dec0 = (F.lit(v) if not isinstance(v, Column) else v for v in (ra0, dec0))
    x, y, d0 = F.radians(xi), F.radians(eta), F.radians(dec0)
    down = F.cos(d0) - y * F.sin(d0)
    ra = ra0 + F.degrees(F.atan2(x, down))
    return F.pmod(ra, F.lit(360.0)), F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.sqrt(x * x + down * down)))


def optimal_frame(corners: DataFrame, resolution_arcsec: float, pad: int = 0) -> Frame:
    """The smallest north-up frame that holds all ``corners`` (ra, dec), at a resolution, padded. Its centre is that of the corners' mean direction."""
    a, d = F.radians("ra"), F.radians("dec")
    x, y, z = corners.agg(F.avg(F.cos(d) * F.cos(a)), F.avg(F.cos(d) * F.sin(a)), F.avg(F.sin(d))).first()
    if x is None:
        raise ValueError("no exposure to frame")
    ra0, dec0 = math.degrees(math.atan2(y, x)) % 360, math.degrees(math.atan2(z, math.hypot(x, y)))
    step = resolution_arcsec / 3600
    xi, eta = plane(F.col("ra"), F.col("dec"), ra0, dec0)
    lo_x, hi_x, lo_y, hi_y = corners.agg(F.min(-xi / step), F.max(-xi / step), F.min(eta / step), F.max(eta / step)).first()
    nx, ny = math.ceil(hi_x - lo_x) + 1, math.ceil(hi_y - lo_y) + 1
    return Frame((ra0, dec0), (1 - math.floor(lo_x), 1 - math.floor(lo_y)), ((-step, 0.0), (0.0, step)), ny, nx).padded(pad)


def sub_size(det_shape: Sequence[int], ref_resolution: float, det_resolution: float, pad: float = 0.0) -> int:
    """Width of a square that holds a detector in any rotation, in pixels of the reference frame."""
    return math.ceil(math.sqrt(2) * max(det_shape) / (ref_resolution / det_resolution) * (1 + 2 * pad))


def sub_origin(centre: Column, width: int) -> Column:
    """First pixel of a sub-frame about ``centre``; truncated toward 0."""
    return (centre - width // 2).cast("int")
