"""Sinks: frames, caches, calibrations, mosaics and instrument tables, as Parquet and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Frame
from ..schemas import schema


def write_frames(obs: DataFrame, path: str, *, replace_existing: bool = False) -> None:
    """Frames, a partition each. Unless ``replace_existing``, frames that are there stay as they are; with it, only those in ``obs`` are replaced."""
    spark = obs.sparkSession
    if not replace_existing:
        try:
            done = spark.read.parquet(path).select("frame").distinct()
            obs = obs.join(done, "frame", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    writer = obs.repartition("frame").write.partitionBy("frame").option("compression", "zstd")
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite" if replace_existing else "append").parquet(path)


def write_cache(obs: DataFrame, path: str, *, weight: str = "weight") -> DataFrame:
    """Observations of weight other than 0, read back: what all passes of a mosaic share. The box that they lie in is ``resample.bounds``'."""
    obs.where(F.col(weight) != 0).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return obs.sparkSession.read.parquet(path)


def write_calibration(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_mosaic(maps: DataFrame, path: str, *, overwrite: bool = True) -> None:
    """Map records, a partition for each upper-cased name."""
    named = maps.withColumn("map_name", F.upper("map_name"))
    named.write.partitionBy("map_name").mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(path)


def append_maps(maps: DataFrame, more: DataFrame) -> DataFrame:
    """``maps`` with the named maps of ``more`` added, or replaced where the name is there."""
    names = more.select("map_name").distinct()
    return maps.join(F.broadcast(names), "map_name", "left_anti").unionByName(more, allowMissingColumns=True)  # some map names


def write_reference_frame(spark, frame: Frame, path: str) -> None:
    row = [(list(frame.crpix), list(frame.crval), [list(r) for r in frame.cd], ["RA---TAN", "DEC--TAN"], frame.ny, frame.nx)]
    spark.createDataFrame(row, schema("ref_frame")).write.mode("overwrite").parquet(path)


def write_lvf_params(spark, params: dict, path: str) -> None:
    row = [(params["xc"], params["yc"], list(params["R"]), list(params["wave_edges"]))]
    spark.createDataFrame(row, schema("lvf")).write.mode("overwrite").json(path)


def remapped(path: Column, old: str, new: str) -> Column:
    """A path with its leading directory replaced."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def recalibrated_gain(obs: DataFrame, old: DataFrame, new: DataFrame, *, value: str = "value") -> DataFrame:
    """``obs`` with values times new gain over old gain (``det_y, det_x, gain``), null where the old one is 0."""
    both = old.select("det_y", "det_x", F.col("gain").alias("_old")).join(new.select("det_y", "det_x", F.col("gain").alias("_new")), ["det_y", "det_x"])
    return obs.join(both, ["det_y", "det_x"]).withColumn(value, F.col(value) * F.try_divide(F.col("_new"), F.col("_old"))).drop("_old", "_new")


def dropped(files: DataFrame, *tokens: str, path: str = "file_path") -> DataFrame:
    """A list of files without those whose path has all of ``tokens``."""
    both = F.lit(True)
    for t in tokens:
        both = both & F.col(path).contains(t)
    return files.where(~both)
