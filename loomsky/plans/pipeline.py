"""The jobs: reproject exposures, calibrate offsets, make mosaics. Each step is a lazy plan until it is stored."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.geometry import Frame, optimal_frame
from ..operators import blocks, coadd, prepare, reproject, solver, system
from ..sources import readers, sinks


@contextmanager
def timed(name: str, report: Callable[[str], None] = print):
    """Report the wall-clock seconds of a step."""
    start = time.perf_counter()
    yield
    report(f"{name}: {time.perf_counter() - start:.2f} s")


@dataclass
class Config:
    """Where a run keeps its things, and how it solves and combines."""

    output_dir: str
    run_name: str
    ref_path: str = ""
    frames_path: str = ""
    calibration_path: str = ""
    mosaic_path: str = ""
    resolution_arcsec: float = 6.2
    pad: int = 0
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[\w.-]+", self.run_name):
            raise ValueError(f"run_name {self.run_name!r} is no name of a folder")
        base = f"{self.output_dir.rstrip('/')}/{self.run_name}"
        self.ref_path = self.ref_path or f"{base}/ref"
        self.frames_path = self.frames_path or f"{base}/reprojected"
        self.calibration_path = self.calibration_path or f"{base}/calibration"
        self.mosaic_path = self.mosaic_path or f"{base}/mosaic"


class Reprojector:
    """Exposures onto one reference frame."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config

    def define_reference(self, corners: DataFrame | None = None) -> Frame:
        """The stored frame; if there is none, the smallest about ``corners`` (ra, dec), which is stored."""
        try:
            return readers.reference_frame(self.spark, self.config.ref_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) or corners is None:
                raise
        frame = optimal_frame(corners, self.config.resolution_arcsec, self.config.pad)
        sinks.write_reference_frame(self.spark, frame, self.config.ref_path)
        return frame

    def run(self, exposures: DataFrame, pixels: DataFrame, frame: Frame, width: int, *, method: str = "interp", replace_existing: bool = False, **options) -> None:
        """Reproject and store the frames that aren't stored yet: by ``interp``, ``exact`` or ``adaptive``, with its ``options``."""
        if method not in reproject.METHODS:
            raise ValueError(f"method {method!r} is none of {sorted(reproject.METHODS)}")
        found = reproject.METHODS[method](exposures, pixels, frame, width, **options)
        sinks.write_frames(found, self.config.frames_path, replace_existing=replace_existing)

    def frames(self) -> DataFrame:
        return self.spark.read.parquet(self.config.frames_path)


class Calibrator:
    """The joint estimate of the sky and of each frame's offsets.

    ``obs`` has ``frame`` (from 0 on, without gaps), ``ref_y, ref_x, chunk, value, weight`` and, where several chunks share a pixel, ``share``."""

    def __init__(self, obs: DataFrame, ny: int, nx: int, n_chunks: int, config: Config | None = None):
        self.obs, self.ny, self.nx, self.n_chunks, self.config = obs, ny, nx, n_chunks, config
        self.a = self.b = self.counts = self.found = None
        self.rows = self.beside = None

    def setup(
        self,
        *,
        outlier_threshold: float | None = None,
        adjacency: DataFrame | None = None,
        reg_weight: float = 0.0,
        mean_offsets: DataFrame | None = None,
        damp_weight: float = 0.0,
    ) -> Calibrator:
        """Build A and b: data rows without outliers, then regularisation, mean-offset and damping rows where they are asked for."""
        n_sky, seen = self.ny * self.nx, self.obs.where("weight > 0")
        if outlier_threshold:
            bounds = self.small(system.outlier_bounds(seen))
            far = F.abs(F.col("value") - F.col("median")) > F.lit(float(outlier_threshold)) * F.lit(system.MAD_TO_STD) * F.col("mad")
            known = ~F.isnan(F.col("value").cast("double"))
            seen = seen.join(bounds, "frame").where(~F.coalesce(known & far, F.lit(False))).drop("median", "mad")
        order = [c for c in ("ref_y", "ref_x", "chunk", "value", "weight") if c in seen.columns]  # what ties in all of these is the same row
        share = "share" if "share" in seen.columns else None
        if share:
            once = system.dense_rows(seen.select("frame", "ref_y", "ref_x").distinct(), "frame", ["ref_y", "ref_x"])
            numbered = seen.join(once, ["frame", "ref_y", "ref_x"])
        else:
            numbered = system.dense_rows(seen, "frame", order)
        a, b = system.data_rows(numbered, self.ny, self.nx, self.n_chunks, share=share)
        a, b = system.cleaned(a, b)

        def key(kind: str, *parts: str):
            return F.xxhash64(F.lit(kind), *parts)  # row numbers of the other kinds need only differ

        a = a.select("row", "col", F.col("val").cast("double"))
        b = b.select("row", F.col("val").cast("double"))
        beside, right = [], []
        if adjacency is not None and reg_weight > 0:
            reg = system.regularisation_rows(seen, adjacency, float(reg_weight), n_sky, self.n_chunks)
            beside.append(reg.select(key("reg", "frame", "chunk_i", "chunk_j").alias("row"), "col", "val"))
            a = a.unionByName(beside[0])
        if share:
            self.counts = system.entry_counts(a)
        else:
            self.rows = system.observed_rows(seen, self.ny, self.nx, self.n_chunks).where(~F.isnan(F.col("value").cast("double")))
            each = self.rows.select(F.col("sky").alias("col")).unionAll(self.rows.select("off"))
            self.counts = solver.kept(system.entry_counts(each.unionAll(beside[0].select("col")) if beside else each))
        if mean_offsets is not None:
            more, means = system.mean_rows(mean_offsets, n_sky, self.n_chunks, mean="value")
            beside.append(more.select(key("mean", "row").alias("row"), "col", F.col("val").cast("double")))
            right.append(means.select(key("mean", "row").alias("row"), F.col("val").cast("double")))
            a, b = a.unionByName(beside[-1]), b.unionByName(right[0])
        if damp_weight > 0:
            damp = system.damping_rows(self.counts, damp_weight, n_sky)
            a = a.unionByName(damp.select(key("damp", "row").alias("row"), "col", "val"))
            if self.rows is not None:
                lone = damp.select(F.col("col").alias("sky"), F.lit(None).cast("long").alias("off"), F.col("val").alias("weight"), F.lit(0.0).alias("value"))
                seen_rows = self.rows.select("sky", "off", F.col("weight").cast("double"), F.col("value").cast("double"))
                self.rows = seen_rows.unionByName(lone)
        if beside:
            none = b.limit(0).select("row", "val")
            self.beside = reduce(DataFrame.unionByName, beside), reduce(DataFrame.unionByName, right, none)
        self.a, self.b = a, b
        return self

    def small(self, df: DataFrame) -> DataFrame:
        """``df``, a table of frames, written once and broadcast where it, counted, is small."""
        kept = solver.kept(df)
        return F.broadcast(kept) if kept.count() * (24 + 16 * len(kept.columns)) <= reproject.SMALL else kept

    def apply(self, *, resume: bool = False, guess: bool = True, **options) -> solver.Solution:
        """Solve; ``resume`` starts from the last solution, else ``guess`` from the offsets' mean residuals."""
        n_sky = self.ny * self.nx
        x0 = self.found.x if resume and self.found else None
        if self.rows is None:
            x0 = system.first_guess(self.a, self.b, n_sky) if x0 is None and guess else x0
            self.found = solver.solve(self.a, self.b, x0=x0, **options)
        else:
            x0 = system.observed_guess(self.rows, self.beside) if x0 is None and guess else x0
            self.found = blocks.solve_blocks(self.rows, blocks.width_of(self.obs, n_sky), more=self.beside, x0=x0, **options)
        return self.found

    def sky(self) -> DataFrame:
        return solver.sky_and_offsets(self.found.x, self.nx, self.ny * self.nx, self.n_chunks)[0]

    def offsets(self, chunk_map: DataFrame | None = None) -> DataFrame:
        """``frame, chunk, value``, with their coverage where the chunk map is given."""
        off = solver.sky_and_offsets(self.found.x, self.nx, self.ny * self.nx, self.n_chunks)[1]
        if chunk_map is None:
            return off
        seen = system.coverage(self.counts, chunk_map, self.ny * self.nx, self.n_chunks)
        return off.join(seen, ["frame", "chunk"], "left").select(
            "frame", "chunk", "value", F.coalesce("n", F.lit(0)).alias("coverage"), F.coalesce("frac", F.lit(0.0)).alias("coverage_frac")
        )

    def save(self, frames: DataFrame, chunk_map: DataFrame, path: str | None = None) -> None:
        tables = {"sky": self.sky(), "offset": self.offsets(chunk_map), "frame": frames}
        sinks.write_calibration(tables, path or self.config.calibration_path)


class Mosaicker:
    """Maps of the calibrated observations."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.maps = spark, config, None
        self.offsets = self.frames = None

    def load_calibration(self, path: str | None = None) -> Mosaicker:
        """Offsets, and the list of frames that they belong to, which replaces any other."""
        tables = readers.calibration(self.spark, path or self.config.calibration_path)
        self.offsets, self.frames = tables["offset"], tables["frame"]
        return self

    def make(
        self, obs: DataFrame, *, sigma: float | None = None, std: bool = True, threshold: float = 0.01, normalize: bool = False, unit: str = "", **preparation
    ) -> DataFrame:
        """``mean_map``, and with ``std`` ``std_map``, and with ``sigma`` too ``sc_mean_map``, as map records. The prepared observations are kept for all passes."""
        preparation = dict(preparation)
        mean_offset = F.lit(None).cast("double")
        if self.offsets is not None and "offset_surface" not in preparation:
            valid = masks.valid_offsets(self.offsets, threshold=threshold, normalize=normalize)
            preparation["offsets"] = valid.select("frame", "chunk", "value")
            mean_offset = F.lit(valid.agg(F.first("mean_offset")).first()[0])
            obs = obs.join(self.frames.select("frame"), "frame", "left_semi") if self.frames is not None else obs
        kept = prepare.prepare(obs, **preparation).where("weight <> 0").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            passes = {"mean_map": coadd.coadd_mean(kept)}
            if std:
                passes["std_map"] = coadd.coadd_std(kept)
                if sigma:
                    passes["sc_mean_map"] = coadd.coadd_sigma_clip(kept, sigma)
            maps = None
            for name, found in passes.items():
                record = found.select(
                    F.lit(name).alias("map_name"), "ref_y", "ref_x", "data", "weight", F.array().cast("array<double>").alias("aux"),
                    F.lit(unit).alias("unit"), mean_offset.alias("mean_offset"),
                )
                maps = record if maps is None else maps.unionByName(record)
            self.maps = solver.kept(maps)
        finally:
            kept.unpersist()
        return self.maps

    def append(self, more: DataFrame) -> DataFrame:
        """Add or replace named maps."""
        self.maps = more if self.maps is None else sinks.append_maps(self.maps, more)
        return self.maps

    def save(self, path: str | None = None, *, overwrite: bool = True) -> None:
        sinks.write_mosaic(self.maps, path or self.config.mosaic_path, overwrite=overwrite)
