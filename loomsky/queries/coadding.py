"""Queries of masks and co-addition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks
from ..operators import coadd, selection, system
from ..operators.store import Store
from ..sources import tiled
from ..sources.views import FRAMES_SQL, GRID_SQL, OBS_SQL, WIDTH, frames, grid, obs
from . import query

VW = {"value": "v", "weight": "w"}


@query(f"""WITH {OBS_SQL}
SELECT ref_y, ref_x, CAST(sum(w * v) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS data, CAST(sum(w) AS BIGINT) AS weight
FROM obs WHERE (dq & 8) = 0 GROUP BY ref_y, ref_x""")
def coadd_mean(spark, sf_dir):
    good = masks.is_good(F.col("dq"), ignore=[b for b in range(32) if b != 3])
    return coadd.coadd_mean(obs(spark, sf_dir).where(good), **VW)


_STATS = """stats AS (
  SELECT ref_y, ref_x, CAST(sum(w) AS DOUBLE) AS sw, CAST(sum(w * v) AS DOUBLE) AS swv, CAST(sum(w * v * v) AS DOUBLE) AS swvv FROM obs GROUP BY ALL),
moments AS (
  SELECT ref_y, ref_x, sw, swv / sw AS mean, sqrt(greatest(swvv / sw - (swv / sw) * (swv / sw), 0e0)) AS std FROM stats)"""


@query(f"WITH {OBS_SQL}, {_STATS} SELECT ref_y, ref_x, std AS data, CAST(sw AS BIGINT) AS weight FROM moments")
def coadd_std(spark, sf_dir):
    return coadd.coadd_std(obs(spark, sf_dir), exact=True, **VW)


@query(f"""WITH {OBS_SQL}, {_STATS}
SELECT ref_y, ref_x, CASE WHEN sum(k) > 0 THEN CAST(sum(k * v) AS DOUBLE) / CAST(sum(k) AS DOUBLE) ELSE 0e0 END AS data, CAST(sum(k) AS BIGINT) AS weight
FROM (SELECT ref_y, ref_x, v, CASE WHEN abs(v - mean) <= 1.5e0 * std THEN w ELSE 0 END AS k FROM obs JOIN moments USING (ref_y, ref_x))
GROUP BY ref_y, ref_x""")
def coadd_sigma_clip(spark, sf_dir):
    return coadd.coadd(obs(spark, sf_dir), "sigma_clip", sigma=1.5, exact=True, **VW)


@query(f"""WITH {OBS_SQL}
SELECT ref_y, ref_x, CAST(sum(w * v) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS data, CAST(sum(w) AS BIGINT) AS weight,
       CAST(sum(w * tax) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS tax, CAST(sum(w * dq) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS dq
FROM obs GROUP BY ref_y, ref_x""")
def coadd_aux(spark, sf_dir):
    return coadd.coadd(obs(spark, sf_dir), "mean", aux=("tax", "dq"), **VW)


@query(f"""WITH {OBS_SQL} SELECT frame, ref_y, ref_x, v, w FROM obs WHERE w <> 0 AND (dq & 1) = 0""")
def coadd_cache(spark, sf_dir):
    weighed = obs(spark, sf_dir).withColumn("w", F.when(masks.is_flagged(F.col("dq"), range(1, 32)), 0).otherwise(F.col("w")))
    return coadd.coadd(weighed, "cache", weight="w").select("frame", "ref_y", "ref_x", "v", "w")


@query(f"""WITH {OBS_SQL}, side AS (SELECT max(ref_y) AS last FROM obs) SELECT frame, ref_y, ref_x, ord, line, v, w FROM obs, side WHERE w <> 0 AND (dq & 1) = 0 AND ref_y BETWEEN last // 4 AND last // 2 AND ref_x BETWEEN 10 AND 29""")
def cached_box(spark, sf_dir):
    """A part of the sky from a cache that is stored in the order of the sky: only files whose boxes meet it are opened."""
    seen = obs(spark, sf_dir)
    weighed = seen.withColumn("w", F.when(masks.is_flagged(F.col("dq"), range(1, 32)), 0).otherwise(F.col("w")))
    path = Store(spark).place()
    tiled.write_tiled(weighed.select("frame", "ref_y", "ref_x", "ord", "line", "v", "w"), path, files=16, tile=8, weight="w")
    last = seen.agg(F.max("ref_y")).first()[0]
    return tiled.read_box(spark, path, last // 4, last // 2, 10, 29)


@query(f"""WITH {OBS_SQL},
joined AS (SELECT ref_y, ref_x, w * p_size AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS c, CAST(p_size AS BIGINT) AS s FROM obs JOIN part ON pix = p_partkey),
sums AS (SELECT ref_y, ref_x, CAST(sum(k) AS DOUBLE) AS w0, CAST(sum(k * c) AS DOUBLE) AS c0, sum(k * (s * s / 12e0 + c * c)) AS q0, CAST(sum(k) AS BIGINT) AS weight FROM joined WHERE k > 0 GROUP BY ALL)
SELECT ref_y, ref_x, floor(c0 / w0 + 0.5e0) AS wav_mean, floor(sqrt(greatest(q0 / w0 - (c0 / w0) * (c0 / w0), 0e0)) + 0.5e0) AS wav_std, weight FROM sums""")
def wav_moments(spark, sf_dir):
    bands = grid(spark, sf_dir).select(F.col("cell").alias("pix"), F.col("raster").alias("bc"), F.col("chunk").alias("bw"))
    seen = obs(spark, sf_dir).join(bands, "pix")
    found = coadd.wavelength_moments(seen, weight="w")
    return found.select("ref_y", "ref_x", F.floor(F.col("wav_mean") + 0.5).cast("double").alias("wav_mean"), F.floor(F.col("wav_std") + 0.5).cast("double").alias("wav_std"), "weight")


@query(f"""WITH {OBS_SQL},
m AS (SELECT frame, median(v) AS med FROM obs GROUP BY frame),
d AS (SELECT frame, median(abs(v - med)) AS mad FROM obs JOIN m USING (frame) GROUP BY frame)
SELECT frame, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE abs(v - med) > 1.5e0 * 1.4826e0 * mad) AS BIGINT) AS n_outliers, any_value(med) AS median, any_value(mad) AS mad
FROM obs JOIN m USING (frame) JOIN d USING (frame) GROUP BY frame""")
def frame_outliers(spark, sf_dir):
    found = system.outliers(obs(spark, sf_dir), 1.5, value="v")
    return found.groupBy("frame").agg(
        F.count("*").alias("n"), F.count_if("is_outlier").alias("n_outliers"), F.first("median").alias("median"), F.first("mad").alias("mad")
    )


@query(f"""WITH {OBS_SQL}, q AS (SELECT frame, quantile_cont(v, [0.25, 0.5, 0.9]) AS q FROM (SELECT -1 AS frame, v FROM obs UNION ALL SELECT frame, v FROM obs) GROUP BY frame)
SELECT frame, unnest([0.25e0, 0.5e0, 0.9e0]) AS share, CAST(round(unnest(q) * 100) AS BIGINT) AS hundredths FROM q""")
def frame_quantiles(spark, sf_dir):
    """Quantiles of each frame, and of a frame -1 that has every observation, which no task holds."""
    seen = obs(spark, sf_dir).select("frame", "v")
    found = selection.quantiles(seen.withColumn("frame", F.lit(-1).cast("bigint")).union(seen), ["frame"], "v", [0.25, 0.5, 0.9])
    return found.select("frame", "share", F.round(F.col("value") * 100).cast("bigint").alias("hundredths"))


def _bright(p: float) -> str:
    return f"""WITH {OBS_SQL}, cut AS (SELECT frame, quantile_cont(v, {p}) AS c FROM obs GROUP BY frame)"""


@query(_bright(0.25) + """
SELECT frame, ord, line, pix, CASE WHEN v > c THEN NULL ELSE CAST(v AS DOUBLE) END AS v FROM obs JOIN cut USING (frame)""")
def bright_cut_p25(spark, sf_dir):
    cut = coadd.bright_cut(obs(spark, sf_dir), 0.25, value="v")
    return cut.select("frame", "ord", "line", "pix", F.when(~F.isnan("v"), F.col("v")).alias("v"))


@query(_bright(0.5) + """
SELECT frame, ord, line, pix, CASE WHEN v > c THEN 0 ELSE w END AS w FROM obs JOIN cut USING (frame)""")
def bright_cut_p50(spark, sf_dir):
    return coadd.bright_cut(obs(spark, sf_dir), 0.5, value="v", weight="w", drop="weight").select("frame", "ord", "line", "pix", "w")


@query(f"""WITH {OBS_SQL}, {FRAMES_SQL},
m AS (SELECT frame, chunk, CAST(sum(v) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS value FROM obs WHERE (dq & 2) = 0 GROUP BY ALL)
SELECT f.frame, c.chunk, coalesce(m.value, 0e0) AS value FROM frames f CROSS JOIN (SELECT unnest(range(7)) AS chunk) c LEFT JOIN m ON m.frame = f.frame AND m.chunk = c.chunk""")
def chunk_mean_guess(spark, sf_dir):
    good = masks.is_good(F.col("dq"), [b for b in range(32) if b != 1])
    return system.chunk_means(obs(spark, sf_dir), frames(spark, sf_dir), 7, good=good, value="v")


@query(f"WITH {OBS_SQL} SELECT frame, ord, line, pix, (dq & 13) = 0 AS good FROM obs")
def dq_good(spark, sf_dir):
    return obs(spark, sf_dir).select("frame", "ord", "line", "pix", masks.is_good(F.col("dq"), ["hot"], {"hot": 1}).alias("good"))


@query(f"""WITH {OBS_SQL} SELECT frame, bit, CAST(count(*) FILTER (WHERE ((dq >> bit) & 1) = 1 AND bit <> 2) AS BIGINT) AS n
FROM obs CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS bit) GROUP BY ALL""")
def dq_expand(spark, sf_dir):
    planes = obs(spark, sf_dir).select("frame", F.posexplode(masks.expand_bits(F.col("dq"), 4, ignore=[2])).alias("bit", "set"))
    return planes.groupBy("frame", "bit").agg(F.count_if("set").alias("n"))


@query(f"WITH {OBS_SQL} SELECT frame, ord, line, pix, dq & 11 AS dq FROM obs")
def dq_pack(spark, sf_dir):
    word = masks.pack_bits(masks.expand_bits(F.col("dq"), 32, ignore=[2]))
    return obs(spark, sf_dir).select("frame", "ord", "line", "pix", word.alias("dq"))


@query(f"""WITH {OBS_SQL} SELECT frame, ord, line, pix, CASE WHEN flag = 'N' THEN 0e0 ELSE CAST(v AS DOUBLE) END AS value, CASE WHEN flag = 'N' THEN 0 ELSE w END AS weight, flag = 'N' AS bad FROM obs""")
def nan_to_zero_weight(spark, sf_dir):
    seen = obs(spark, sf_dir).withColumn("value", F.when(F.col("flag") == "N", F.lit(float("nan"))).otherwise(F.col("v").cast("double")))
    seen = seen.withColumn("bad", masks.invalid(seen, "value")).withColumnRenamed("w", "weight")
    return masks.nan_to_zero(seen).select("frame", "ord", "line", "pix", "value", "weight", "bad")


@query(f"""WITH {OBS_SQL} SELECT frame, ord, line, pix, CASE WHEN dq = 0 THEN {masks.LARGEST!r} ELSE 1e0 / CAST(dq * dq AS DOUBLE) END AS weight FROM obs""")
def inverse_weight(spark, sf_dir):
    weight = masks.inverse_square_weight(F.col("dq").cast("double"))
    return obs(spark, sf_dir).select("frame", "ord", "line", "pix", weight.alias("weight"))


@query(f"""WITH {GRID_SQL}, s AS (SELECT chunk, CAST(count(*) AS DOUBLE) / (SELECT max(c) FROM (SELECT count(*) AS c FROM grid GROUP BY chunk)) AS weight FROM grid GROUP BY chunk) SELECT * FROM s""")
def weight_norm(spark, sf_dir):
    sizes = grid(spark, sf_dir).groupBy("chunk").agg(F.count("*").alias("weight"))
    return coadd.normalized(sizes, "weight")


@query("""WITH s AS (SELECT CAST(c AS BIGINT) AS sub, c BETWEEN 48 AND 73 OR c BETWEEN 108 AND 133 AS valid FROM (SELECT unnest(range(172)) AS c)),
used AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS sub FROM part)
SELECT sub * 3 + k AS chunk, valid FROM s CROSS JOIN (SELECT CAST(unnest(range(3)) AS BIGINT) AS k) WHERE sub IN (SELECT sub FROM used)""")
def channel_mask(spark, sf_dir):
    used = grid(spark, sf_dir).select("chunk").distinct()
    mask = masks.channel_mask(spark, [6, 7, 12, 13], n_channels=17, n_sub=10, pad=3)
    return masks.strip_mask(mask.join(used, "chunk", "left_semi"), 3)


@query(f"""WITH {GRID_SQL} SELECT cell, chunk + 200 BETWEEN 225 AND 235 AS valid FROM grid""")
def feature_mask(spark, sf_dir):
    cells = grid(spark, sf_dir).select("cell", (F.col("chunk") + 200).alias("chunk"))
    return cells.join(masks.feature_mask(spark, "Aromatic", 342), "chunk").select("cell", "valid")


@query(f"""WITH {OBS_SQL}, c AS (SELECT frame, chunk, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM obs GROUP BY ALL),
z AS (SELECT chunk, count(*) AS size FROM obs GROUP BY chunk), j AS (SELECT frame, chunk, s, CAST(n AS DOUBLE) / size AS frac FROM c JOIN z USING (chunk)),
m AS (SELECT CAST(sum(s) FILTER (WHERE frac >= 0.01e0) AS DOUBLE) / CAST(count(*) FILTER (WHERE frac >= 0.01e0) AS DOUBLE) AS mean FROM j)
SELECT frame, chunk, frac >= 0.01e0 AS is_valid, CASE WHEN frac >= 0.01e0 THEN floor(CAST(s AS DOUBLE) - mean + 0.5e0) ELSE 0e0 END AS value FROM j CROSS JOIN m""")
def offset_validity(spark, sf_dir):
    seen = obs(spark, sf_dir)
    sums = seen.groupBy("frame", "chunk").agg(F.sum("v").alias("value"), F.count("*").alias("n"))
    sizes = seen.groupBy("chunk").agg(F.count("*").alias("size"))
    offsets = sums.join(sizes, "chunk").withColumn("coverage_frac", F.col("n") / F.col("size"))
    found = masks.valid_offsets(offsets, threshold=0.01)
    return found.select("frame", "chunk", "is_valid", F.when(F.col("is_valid"), F.floor(F.col("value") + 0.5).cast("double")).otherwise(0.0).alias("value"))


@query(f"""SELECT o_orderkey AS exp, o_totalprice AS price FROM orders WHERE coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 END, 2) = 0""")
def astrometry_filter(spark, sf_dir):
    from ..sources.views import table

    flag = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1)
    headers = table(spark, sf_dir, "orders").withColumn("finast", flag)
    return headers.where(masks.header_flag_ok(F.col("finast"))).select(F.col("o_orderkey").alias("exp"), F.col("o_totalprice").alias("price"))


assert WIDTH == 50  # the SQL above has it
