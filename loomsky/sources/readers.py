"""Sources: exposure catalogues and lists, frames, calibrations, instrument tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators.solver import kept
from ..operators.system import dense_rows
from ..schemas import schema


def catalogue(df: DataFrame, ra: float, dec: float, radius: float, base: str = "", pattern: str = "", *, name: str = "name") -> DataFrame:
    """``file_path`` of catalogue rows (``name, ra, dec``) strictly within ``radius`` degrees whose name contains ``pattern``; rows without a
    name or a place are left out."""
    named = df.where(F.col(name).isNotNull() & F.col("ra").isNotNull() & F.col("dec").isNotNull())
    named = named.where(F.col(name).contains(pattern)) if pattern else named
    path = F.concat(F.lit(f"{base.rstrip('/')}/"), name) if base else F.col(name)
    return geometry.cone(named, ra, dec, radius).select(path.alias("file_path"))


def exposure_list(spark: SparkSession, path: str) -> DataFrame:
    """``file_path``: the first column of a CSV file without a header, stripped, where there is anything."""
    first = spark.read.csv(path, header=False)
    return first.select(F.trim(first.columns[0]).alias("file_path")).where("file_path <> ''")


def directory(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """``file_path`` of the files in a folder whose name contains ``pattern``, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{pattern}*").load(path)
    return files.select(F.col("path").alias("file_path"))


def union_sorted(*lists: DataFrame) -> DataFrame:
    """Lists of paths as one, in order."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.orderBy("file_path")


def exposure_index(path: Column) -> Column:
    """``exp, det`` of a name like ``exp_0012_det_05.parquet``; nulls where it isn't one."""
    exp = F.try_element_at(F.regexp_extract_all(path, F.lit(r"exp_([0-9]+)_det_"), F.lit(1)), F.lit(-1))
    det = F.try_element_at(F.regexp_extract_all(path, F.lit(r"_det_([0-9]+)"), F.lit(1)), F.lit(-1))
    return F.struct(exp.cast("int").alias("exp"), det.cast("int").alias("det"))


def week_numbers(df: DataFrame, path: str = "file_path") -> DataFrame:
    """``week``: the weeks that paths name, like ``_2025W17_``, each once. Paths without one are left out."""
    week = F.regexp_extract(F.col(path), r"_[0-9]{4}W([0-9]+)_", 1)
    return df.where(week != "").select(week.cast("int").alias("week")).distinct()


def numbered(df: DataFrame, path: str = "file_path", name: str = "frame") -> DataFrame:
    """A list of files numbered from 0 on in the order of their paths. Each range of paths is numbered by itself, from the sizes of those before
    it; the ranges are drawn anew by each run, so they are written to the shared folder once."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(ranges, path).withColumn("_range", F.spark_partition_id()))
    return dense_rows(dealt, "_range", [path], name).drop("_range").withColumn(name, F.col(name).cast("int"))


def frames(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Reprojected frames, only the named fields; fields that the files lack are null. Corrupt files are skipped."""
    df = spark.read.schema(schema("obs")).option("ignoreCorruptFiles", "true").parquet(path)
    return df.select(*(fields or df.columns))


def with_missing(listed: DataFrame, seen: DataFrame, by: str = "frame") -> DataFrame:
    """The list of frames with ``is_missing``: those that no row was read from."""
    present = seen.select(by).distinct().withColumn("_seen", F.lit(True))
    return listed.join(present, by, "left").withColumn("is_missing", F.col("_seen").isNull()).drop("_seen")


def readable(listed: DataFrame) -> DataFrame:
    """Frames that aren't missing; nothing is deleted."""
    return listed.where("not is_missing")


def band_tables(spark: SparkSession, path: str, band: int) -> DataFrame:
    """``det_y, det_x, bc, bw`` of a band, from the one file of centres and the one of widths that ``path`` must have for it."""
    parts = []
    for kind in ("BC", "BW"):
        files = directory(spark, path, f"{kind}_Band{band}.").select("file_path").limit(2).collect()
        if len(files) != 1:
            raise ValueError(f"{path} has {'no' if not files else 'more than one'} {kind} file of band {band}")
        parts.append(spark.read.parquet(files[0].file_path).select("det_y", "det_x", F.col("value").alias(kind.lower())))
    return parts[0].join(parts[1], ["det_y", "det_x"])


def lvf_params(spark: SparkSession, path: str) -> dict | None:
    """Arc parameters, or None where there are none."""
    try:
        row = spark.read.schema(schema("lvf")).json(path).first()
    except Exception as e:  # the path's absence has a class of its own only in some Spark versions
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row.asDict() if row else None


def calibration(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored calibration: ``sky, offset, frame``."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("sky", "offset", "frame")}


def reference_frame(spark: SparkSession, path: str) -> geometry.Frame:
    """A stored reference frame."""
    row = spark.read.schema(schema("ref_frame")).parquet(path).first()
    return geometry.Frame(tuple(row.crval), tuple(row.crpix), tuple(map(tuple, row.cd)), row.ny, row.nx)


def headers(df: DataFrame, keys: Sequence[str], header: str = "header") -> DataFrame:
    """Exposures' header values as columns, as numbers where they are; exposures that lack any are left out, and it's an error if none is left."""
    out = df.select("*", *[F.try_element_at(header, F.lit(k)).cast("double").alias(k.lower()) for k in keys])
    out = out.where(F.expr(" and ".join(f"{k.lower()} is not null" for k in keys)))
    if out.isEmpty():
        raise ValueError(f"no exposure has all of {list(keys)}")
    return out


def run_config(text: str) -> dict:
    """A run's configuration from JSON text."""
    return json.loads(text)
