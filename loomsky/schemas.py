"""Schemas of the data model: everything is a long table keyed by frame, by sky pixel, by raster cell, or by (frame, chunk)."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    # one row per exposure file
    "exposure": "exp_idx INT, det_idx INT, file_path STRING, header MAP<STRING,STRING>",
    # one row per observed pixel, in the reference frame's pixels
    "obs": "frame INT, sub_y INT, sub_x INT, ref_y BIGINT, ref_x BIGINT, value DOUBLE, dq BIGINT, map_x DOUBLE, map_y DOUBLE, weight DOUBLE, foot FLOAT",
    "frame": "frame INT, exp_idx INT, det_idx INT, file_path STRING, y_min INT, y_max INT, x_min INT, x_max INT, is_missing BOOLEAN",
    "ref_frame": "crpix ARRAY<DOUBLE>, crval ARRAY<DOUBLE>, cd ARRAY<ARRAY<DOUBLE>>, ctype ARRAY<STRING>, ny INT, nx INT",
    "chunk_map": "det_y BIGINT, det_x BIGINT, chunk BIGINT",
    "chunk_valid": "chunk BIGINT, valid BOOLEAN",
    "grid_weight": "det_y BIGINT, det_x BIGINT, weight DOUBLE",
    "system_a": "row BIGINT, col BIGINT, val DOUBLE",
    "system_b": "row BIGINT, val DOUBLE",
    "sky": "ref_y BIGINT, ref_x BIGINT, value DOUBLE, coverage BIGINT",
    "offset": "frame INT, chunk BIGINT, value DOUBLE, coverage BIGINT, coverage_frac DOUBLE",
    "maps": "map_name STRING, ref_y BIGINT, ref_x BIGINT, data DOUBLE, weight DOUBLE, aux ARRAY<DOUBLE>, unit STRING, mean_offset DOUBLE",
    "band": "det_y BIGINT, det_x BIGINT, bc DOUBLE, bw DOUBLE",
    "lvf": "xc DOUBLE, yc DOUBLE, R ARRAY<DOUBLE>, wave_edges ARRAY<DOUBLE>",
    "cube": "ref_y BIGINT, ref_x BIGINT, data ARRAY<DOUBLE>, wave ARRAY<DOUBLE>",
    "adjacency": "chunk_i BIGINT, chunk_j BIGINT",
}


def schema(name: str) -> StructType:
    """The named schema; a KeyError names what there is."""
    if name not in _DDL:
        raise KeyError(f"no schema {name!r}; there are {sorted(_DDL)}")
    return StructType.fromDDL(_DDL[name])
