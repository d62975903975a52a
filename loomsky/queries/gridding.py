"""Queries of resampling, chunk maps and window-shaped operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, resample
from ..sources.views import GRID_SQL, OBS_SQL, grid, obs, table
from . import query

POINT = ["frame", "ord", "line", "pix"]

#: observations are targets each by itself, also where two share a key
_CORNERS = """corner AS (
  SELECT r, frame, ord, line, pix, map_y // 100 + a AS det_y, map_x // 100 + b AS det_x,
         (CASE WHEN a = 1 THEN map_y % 100 ELSE 100 - map_y % 100 END) * (CASE WHEN b = 1 THEN map_x % 100 ELSE 100 - map_x % 100 END) AS k
  FROM (SELECT row_number() OVER () AS r, * FROM obs) CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b))"""


@query(f"""WITH {OBS_SQL}, {GRID_SQL}, {_CORNERS}
SELECT frame, ord, line, pix, CAST(sum(coalesce(k * raster, 0)) AS DOUBLE) / 10000e0 AS raster FROM corner LEFT JOIN grid USING (det_y, det_x) GROUP BY r, frame, ord, line, pix""")
def bilinear_resample(spark, sf_dir):
    return resample.bilinear(obs(spark, sf_dir), grid(spark, sf_dir), POINT, scale=100)


@query(f"""WITH {OBS_SQL}, {GRID_SQL}, {_CORNERS}
SELECT frame, ord, line, pix, chunk, CAST(sum(k) AS DOUBLE) / 10000e0 AS share FROM corner JOIN grid USING (det_y, det_x) WHERE k > 0 GROUP BY r, frame, ord, line, pix, chunk""")
def chunk_contrib(spark, sf_dir):
    return resample.chunk_contributions(obs(spark, sf_dir), grid(spark, sf_dir), POINT, scale=100)


@query(f"""WITH {OBS_SQL}, {GRID_SQL}, {_CORNERS}, bits AS (SELECT det_y, det_x, b FROM grid CROSS JOIN (SELECT unnest(range(6)) AS b) WHERE ((chunk >> b) & 1) = 1),
s AS (SELECT r, b, sum(k) AS k FROM corner JOIN bits USING (det_y, det_x) GROUP BY r, b),
m AS (SELECT r, CAST(sum(1 << b) AS BIGINT) AS dq FROM s WHERE k > 100 GROUP BY r)
SELECT o.frame, o.ord, o.line, o.pix, coalesce(m.dq, 0) AS dq FROM (SELECT DISTINCT r, frame, ord, line, pix FROM corner) o LEFT JOIN m USING (r)""")
def interp_dq(spark, sf_dir):
    flags = grid(spark, sf_dir).withColumnRenamed("chunk", "dq")
    return resample.resampled_mask(obs(spark, sf_dir), flags, POINT, scale=100)


@query(f"""WITH {GRID_SQL}, {OBS_SQL}, m AS (SELECT chunk, CAST(sum(w * v) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS value FROM obs GROUP BY chunk)
SELECT cell, grid.chunk, value FROM grid JOIN m ON grid.chunk = m.chunk""")
def chunk_gather(spark, sf_dir):
    values = obs(spark, sf_dir).groupBy("chunk").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))
    return resample.gather_chunks(grid(spark, sf_dir), values).select("cell", "chunk", "value")


@query(f"WITH {OBS_SQL} SELECT frame, ord, line, pix, ref_y - 1 AS ref_y, ref_x - 10 AS ref_x FROM obs WHERE ref_y - 1 BETWEEN 0 AND 19 AND ref_x - 10 BETWEEN 0 AND 29")
def crop_to_ref(spark, sf_dir):
    placed = obs(spark, sf_dir).select(*POINT, (F.col("ref_y") - 1).alias("ref_y"), (F.col("ref_x") - 10).alias("ref_x"))
    return resample.crop(placed, 20, 30)


@query(f"WITH {OBS_SQL} SELECT frame, min(ref_y) AS y_min, max(ref_y) + 1 AS y_max, min(ref_x) AS x_min, max(ref_x) + 1 AS x_max FROM obs WHERE w > 25 GROUP BY frame")
def frame_bounds(spark, sf_dir):
    return resample.bounds(obs(spark, sf_dir).where("w > 25"), ["frame"])


@query(f"WITH {GRID_SQL} SELECT det_y // 4 AS det_y, det_x // 4 AS det_x, CAST(sum(raster) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS raster FROM grid GROUP BY det_y // 4, det_x // 4")
def bin2d(spark, sf_dir):
    return resample.bin2d(grid(spark, sf_dir), 4)


@query(f"WITH {GRID_SQL} SELECT det_y // 5 AS det_y, det_x // 5 AS det_x, max(raster) AS raster FROM grid GROUP BY det_y // 5, det_x // 5")
def bin2d_max(spark, sf_dir):
    return resample.bin2d(grid(spark, sf_dir), 5, F.max)


@query(f"""WITH {OBS_SQL} SELECT frame AS row, ((pix // 50) // 2) * 25 + (pix % 50) // 2 AS col, CAST(sum(w) AS DOUBLE) / 4e0 AS val FROM obs GROUP BY ALL""")
def bin_coo(spark, sf_dir):
    matrix = obs(spark, sf_dir).select(F.col("frame").alias("row"), F.col("pix").alias("col"), F.col("w").alias("val"))
    return resample.bin_columns(matrix, 50, 2)


@query(f"WITH {OBS_SQL} SELECT ref_y, ref_x, CAST(sum(CASE WHEN (dq & 3) = 0 THEN w ELSE 0 END) AS BIGINT) AS footprint FROM obs GROUP BY ALL")
def footprint(spark, sf_dir):
    return resample.footprint(obs(spark, sf_dir), F.expr("(dq & 3) = 0"), offset=F.col("w"))


@query("""WITH e AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 1000e0) AS BIGINT) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i)),
n AS (SELECT CAST(unnest(range(15)) AS BIGINT) AS t), p AS (SELECT a.t AS ty, b.t AS tx, a.t * 7 AS my, b.t * 7 AS mx FROM n a CROSS JOIN n b),
c AS (SELECT ty, tx, my // 14 + a AS y, mx // 14 + b AS x, (CASE WHEN a = 1 THEN my % 14 ELSE 14 - my % 14 END) * (CASE WHEN b = 1 THEN mx % 14 ELSE 14 - mx % 14 END) AS k
  FROM p CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b))
SELECT vec_id, ty AS det_y, tx AS det_x, CAST(sum(k * v) AS DOUBLE) / 196e0 AS raster FROM c JOIN e USING (y, x) WHERE k > 0 GROUP BY ALL""")
def upscale2d(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f"))
    raster = cells.select(
        "vec_id", F.expr("i div 8").alias("det_y"), F.expr("cast(i % 8 as bigint)").alias("det_x"), F.floor(F.col("f").cast("double") * 1000).alias("raster")
    )
    return resample.upscale2d(raster, 8, 8, 15, 15, by=["vec_id"])


_BESIDE = f"""{GRID_SQL}, across AS (SELECT a.chunk AS a, b.chunk AS b FROM grid a JOIN grid b ON a.det_y = b.det_y AND b.det_x = a.det_x + 1),
down AS (SELECT a.chunk AS a, b.chunk AS b FROM grid a JOIN grid b ON a.det_x = b.det_x AND b.det_y = a.det_y + 1)"""


@query(f"""WITH {_BESIDE} SELECT DISTINCT least(a, b) AS chunk_i, greatest(a, b) AS chunk_j FROM (SELECT * FROM across UNION ALL SELECT * FROM down) WHERE a <> b""")
def chunk_adjacency(spark, sf_dir):
    return chunks.chunk_adjacency(grid(spark, sf_dir))


@query(f"""WITH {_BESIDE} SELECT DISTINCT least(a, b) AS chunk_i, greatest(a, b) AS chunk_j FROM across WHERE a <> b AND a // 5 = b // 5""")
def column_adjacency(spark, sf_dir):
    return chunks.column_adjacency(grid(spark, sf_dir), 5)


@query(f"""WITH {_BESIDE} SELECT DISTINCT least(a, b) AS chunk_i, greatest(a, b) AS chunk_j FROM down WHERE abs(a // 5 - b // 5) = 1 AND a % 5 = b % 5""")
def subchannel_adjacency(spark, sf_dir):
    return chunks.subchannel_adjacency(grid(spark, sf_dir), 5)


_RADII = [float(100 + 7 * i) for i in range(30)]


@query(f"""WITH {GRID_SQL} SELECT cell, CAST(len(list_filter({_RADII!r}, lambda r: r < sqrt(CAST((det_x - 25) * (det_x - 25) + (det_y - 200) * (det_y - 200) AS DOUBLE)))) AS BIGINT) AS chunk FROM grid""")
def arc_chunk_map(spark, sf_dir):
    return chunks.arc_chunks(grid(spark, sf_dir), 25, 200, _RADII).select("cell", "chunk")


_EDGES17 = [float(100 + 10 * i) for i in range(18)]


@query(f"""WITH {GRID_SQL}, e AS (SELECT list_transform(range(35), lambda i: 100e0 + 5e0 * i) AS r)
SELECT cell, CAST(len(list_filter(r, lambda q: q < sqrt(CAST((det_x - 25) * (det_x - 25) + (det_y - 200) * (det_y - 200) AS DOUBLE)))) AS BIGINT) AS chunk FROM grid CROSS JOIN e""")
def fiducial_chunk_map(spark, sf_dir):
    return chunks.fiducial_chunks(grid(spark, sf_dir), 25, 200, _EDGES17, 17, 2).select("cell", "chunk")


@query(f"""WITH {GRID_SQL} SELECT cell, chunk * 3 + (CASE WHEN det_x >= 33 THEN 2 WHEN det_x >= 16 THEN 1 ELSE 0 END) AS chunk FROM grid""")
def strip_chunk_map(spark, sf_dir):
    return chunks.strip_chunks(grid(spark, sf_dir), 3, 50).select("cell", "chunk")


@query(f"""WITH {GRID_SQL}, z AS (SELECT det_x, det_y FROM grid WHERE chunk % 7 = 0 UNION SELECT det_x, min(det_y) FROM grid GROUP BY det_x),
l AS (SELECT det_x, det_y FROM grid WHERE chunk % 7 = 0 UNION SELECT det_x, max(det_y) FROM grid GROUP BY det_x)
SELECT cell, least(g.det_y - (SELECT max(z.det_y) FROM z WHERE z.det_x = g.det_x AND z.det_y <= g.det_y), (SELECT min(l.det_y) FROM l WHERE l.det_x = g.det_x AND l.det_y >= g.det_y) - g.det_y) AS distance FROM grid g""")
def vertical_dist(spark, sf_dir):
    return chunks.vertical_distance(grid(spark, sf_dir).withColumn("valid", F.col("chunk") % 7)).select("cell", "distance")


@query("""WITH s AS (SELECT user_id, event_type, CAST(row_number() OVER w - 1 AS BIGINT) AS place, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT user_id, event_type, place FROM s WHERE place = 0 OR before <> event_type),
r AS (SELECT user_id, event_type, place AS start, lead(place) OVER w AS "end", row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY user_id ORDER BY place))
SELECT user_id, start, "end", start - 0.5e0 AS edge, (start + "end" - 1) / 2e0 AS centre, event_type FROM r WHERE "end" IS NOT NULL AND n > 1""")
def run_bins(spark, sf_dir):
    return chunks.run_bins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(f"WITH {GRID_SQL} SELECT cell, CAST(sum(raster * chunk) OVER (PARTITION BY det_y ORDER BY det_x) AS BIGINT) AS cumulative FROM grid")
def cum_integral(spark, sf_dir):
    return chunks.cumulative(grid(spark, sf_dir), ["det_y"], ["det_x"], F.col("raster") * F.col("chunk")).select("cell", "cumulative")


@query(f"""WITH {GRID_SQL}, r AS (SELECT cell, det_y, det_x, CAST(sum(raster) OVER (PARTITION BY det_y ORDER BY det_x) AS BIGINT) AS s FROM grid)
SELECT cell, CAST(sum(s) OVER (PARTITION BY det_x ORDER BY det_y) AS BIGINT) AS volume FROM r""")
def cum_volume_2d(spark, sf_dir):
    return chunks.cumulative2d(grid(spark, sf_dir), F.col("raster")).select("cell", "volume")


@query(f"""WITH {GRID_SQL}, s AS (SELECT max(det_y) + 1 AS ny, max(det_x) + 1 AS nx FROM grid)
SELECT 'y' AS axis, unnest(range(0, ny + 1, 8)) AS edge FROM s UNION ALL SELECT 'x', unnest(range(0, nx + 1, 10)) FROM s""")
def chunk_edges(spark, sf_dir):
    shape = grid(spark, sf_dir).agg((F.max("det_y") + 1).alias("ny"), (F.max("det_x") + 1).alias("nx"))
    return chunks.chunk_edges(shape, 8, 10)


@query("""WITH e AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS a FROM part), n AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM e)
SELECT a + (b - a) * i / 4e0 AS edge FROM n CROSS JOIN (SELECT unnest(range(4)) AS i) WHERE b IS NOT NULL UNION ALL SELECT a FROM n WHERE b IS NULL""")
def edge_refine(spark, sf_dir):
    edges = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("edge")).distinct()
    return chunks.refined_edges(edges, 4)


@query(f"WITH {OBS_SQL} SELECT frame, ord, line, pix, CAST((row_number() OVER (PARTITION BY frame ORDER BY ord, line, pix) - 1) // 20 AS BIGINT) AS batch FROM obs")
def batches(spark, sf_dir):
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy("frame").orderBy("ord", "line", "pix")) - 1
    return obs(spark, sf_dir).select(*POINT, F.floor(at / 20).alias("batch"))
