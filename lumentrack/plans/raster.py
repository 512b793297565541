"""Mask, depth and box queries over embeddings and order lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumentrack.operators import flow as fl
from lumentrack.operators import grid as gr
from lumentrack.operators import masks as mk
from lumentrack.operators import raster as ra
from lumentrack.sources.adapters import SQL, detections, pixels, r6, rasters
from lumentrack.sources.tables import table


def _pixels(spark, d):
    return pixels(rasters(table(spark, d, "embeddings")))


def mask_stats(spark, d):
    s = ra.mask_stats(_pixels(spark, d))
    cols = ["coverage", "cx", "cy", "confidence", "depth_consistency", "aspect"]
    return s.withColumns({c: r6(F.col(c)) for c in cols}).withColumn("coverage_score", r6(ra.coverage_score(F.col("coverage"))))


def mask_box_iou(spark, d):
    p = _pixels(spark, d)
    boxes = p.select("mask_id").distinct().select("mask_id", (F.col("mask_id") % 5 - 0.5).alias("bx"), (F.col("mask_id") % 3).cast("double").alias("by_"), (F.col("mask_id") % 7 + 0.9).alias("bw"), F.lit(4.2).alias("bh"))
    return ra.box_iou(p, boxes).withColumn("iou", r6(F.col("iou")))


def mask_depth_point(spark, d):
    s = ra.mask_stats(_pixels(spark, d)).where("area > 0").select("mask_id", "cx", "cy")
    depths = rasters(table(spark, d, "embeddings")).select("mask_id", F.transform("logits", lambda v: F.greatest(F.lit(0.1), F.least(F.lit(100.0), 5 + 10 * v))).alias("depths"))
    return s.join(depths, "mask_id").select("mask_id", r6(F.col("cx")).alias("x"), r6(F.col("cy")).alias("y"), r6(ra.bilinear(F.col("depths"), F.col("cx"), F.col("cy"))).alias("z"))


def mask_weighted_centroid(spark, d):
    """Centroids of masks by the strength of their logits."""
    m = ra.as_runs(rasters(table(spark, d, "embeddings"))).select("mask_id", mk.weighted_centroid(F.col("runs"), F.col("logits"), 8).alias("c"))
    return m.select("mask_id", r6(F.col("c.x")).alias("x"), r6(F.col("c.y")).alias("y"))


def mask_shape(spark, d):
    s = ra.mask_shape(rasters(table(spark, d, "embeddings")))
    return s.withColumns({c: r6(F.col(c)) for c in ("perimeter", "compactness", "fragmentation")})


def mask_quality(spark, d):
    """All scores of a mask and the five-threshold verdict, in one pass over the masks' runs."""
    s = ra.mask_quality(ra.as_runs(rasters(table(spark, d, "embeddings"))).drop("logits"))
    return s.select("mask_id", "frame", *[r6(F.col(c)).alias(c) for c in ("coverage", "compactness", "edge", "fragmentation", "aspect", "overall")], "is_valid")


def depth_confidence(spark, d):
    """Depth maps of 5 + 10 * logit metres, some of it out of range."""
    maps = ra.as_runs(rasters(table(spark, d, "embeddings"))).select("mask_id", "height", "width", F.transform("logits", lambda v: 5 + 10 * v).alias("depth"))
    return ra.depth_confidence(maps).select("mask_id", *[r6(F.col(c)).alias(c) for c in ("valid_ratio", "mean_uncertainty", "confidence")])


def _frames(spark, d):
    """A label is a video, its embeddings in order of id the frames, 8 x 8 gray values; every 29th embedding can't be read."""
    order = Window.partitionBy("frame").orderBy("mask_id")
    return rasters(table(spark, d, "embeddings")).select(F.col("frame").alias("video"), (F.row_number().over(order) - 1).alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.when(F.col("mask_id") % 29 != 0, F.col("logits")).alias("gray"))


def motion_magnitude(spark, d):
    """Mean optical flow of every fifth frame from the last analysed one, until a frame can't be read."""
    return fl.motion_magnitude(_frames(spark, d), 5).withColumn("score", r6(F.col("score")))


def nms(spark, d):
    return gr.nms(detections(table(spark, d, "lineitem")), 0.3).withColumn("confidence", r6(F.col("confidence")))


def temporal_mask_filter(spark, d):
    order = Window.partitionBy("frame").orderBy("mask_id")
    m = rasters(table(spark, d, "embeddings")).select(F.col("frame").alias("obj_id"), (F.row_number().over(order) - 1).alias("frame"), mk.runs(F.col("logits"), 8).alias("runs"), F.lit(True).alias("is_valid"))
    return mk.temporal_filter(m, 0.3).select("obj_id", F.col("frame").alias("pos"))


def retention(spark, d):
    """Share of boxes that suppression keeps, over all frames."""
    boxes = detections(table(spark, d, "lineitem"))
    return boxes.agg(F.count("*").alias("total")).crossJoin(gr.nms(boxes, 0.3).agg(F.count("*").alias("kept"))).select("total", "kept", F.round(F.col("kept") / F.greatest(F.lit(1), F.col("total")), 6).alias("ratio"))  # one row each


QUERIES = {f.__name__: f for f in (mask_stats, mask_box_iou, mask_depth_point, mask_weighted_centroid, mask_shape, mask_quality, depth_confidence, motion_magnitude, nms, temporal_mask_filter, retention)}

_ST = f"""{SQL['px']}, g AS (SELECT mask_id, any_value(frame) AS frame, count(*) FILTER (logit > 0) AS area, count(*) AS size, coalesce(avg(px) FILTER (logit > 0), 0) AS cx, coalesce(avg(py) FILTER (logit > 0), 0) AS cy, avg(abs(logit)) FILTER (logit > 0) AS strength,
  var_pop(depth) FILTER (logit > 0) AS spread, var_samp(py) FILTER (logit > 0) AS vyy, var_samp(px) FILTER (logit > 0) AS vxx, covar_samp(py, px) FILTER (logit > 0) AS vxy FROM px GROUP BY mask_id),
e AS (SELECT *, (vyy + vxx + sqrt(power(vyy - vxx, 2) + 4 * vxy * vxy)) / 2 AS hi, greatest(0.0, (vyy + vxx - sqrt(power(vyy - vxx, 2) + 4 * vxy * vxy)) / 2) AS lo FROM g)"""
_NMS = f"""{SQL['dt']}, n0 AS (SELECT frame, list({{'c': confidence, 'ord': ord, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY confidence DESC, ord) AS bs FROM dt GROUP BY frame),
n1 AS (SELECT frame, unnest(list_reduce(list_transform(bs, lambda b: [b]), lambda k, b: CASE WHEN len(list_filter(k, lambda z: greatest(0.0, least(z.x + z.w, b[1].x + b[1].w) - greatest(z.x, b[1].x)) * greatest(0.0, least(z.y + z.h, b[1].y + b[1].h) - greatest(z.y, b[1].y))
  > 0.3 * (z.w * z.h + b[1].w * b[1].h - greatest(0.0, least(z.x + z.w, b[1].x + b[1].w) - greatest(z.x, b[1].x)) * greatest(0.0, least(z.y + z.h, b[1].y + b[1].h) - greatest(z.y, b[1].y))))) > 0 THEN k ELSE list_concat(k, b) END)) AS b FROM n0)"""
_BITS = f"{SQL['px']}, bt AS (SELECT mask_id, any_value(frame) AS frame, string_agg(CASE WHEN logit > 0 THEN '1' ELSE '0' END, '' ORDER BY py, px)::BIT AS bits FROM px GROUP BY mask_id)"

# The outside is flooded from a corner of the frame with a rim, over sides; components grow over sides and diagonals. Moves of the border are
# listed as in a walk with the outside at the left hand: along rows, along columns, and past an outside pixel between two inside.
_SHAPE = f"""{_ST}, rim AS (SELECT x - 1 AS x, y - 1 AS y FROM range(10) a(x), range(10) b(y)),
fg AS (SELECT mask_id, px AS x, py AS y FROM px WHERE logit > 0), ids AS (SELECT DISTINCT mask_id FROM px),
bg AS (SELECT mask_id, x, y FROM ids, rim EXCEPT SELECT * FROM fg),
ou AS (SELECT mask_id, -1 AS x, -1 AS y FROM ids UNION SELECT b.* FROM ou o JOIN bg b ON b.mask_id = o.mask_id AND abs(b.x - o.x) + abs(b.y - o.y) = 1),
gr AS (SELECT mask_id, y * 8 + x AS root, x, y FROM fg UNION SELECT f.mask_id, g.root, f.x, f.y FROM gr g JOIN fg f ON f.mask_id = g.mask_id AND abs(f.x - g.x) <= 1 AND abs(f.y - g.y) <= 1),
co AS (SELECT mask_id, x, y, min(root) AS c FROM gr GROUP BY ALL),
dr(sx, sy, ox, oy, tx, ty) AS (SELECT 0, 0, 0, -1, 1, 0 UNION ALL SELECT 0, 0, 0, 1, -1, 0 UNION ALL SELECT 0, 0, -1, 0, 0, -1 UNION ALL SELECT 0, 0, 1, 0, 0, 1
  UNION ALL SELECT 0, 0, 1, 0, 1, 1 UNION ALL SELECT 0, 0, 0, -1, 1, -1 UNION ALL SELECT 0, 0, -1, 0, -1, -1 UNION ALL SELECT 0, 0, 0, 1, -1, 1),
mv AS (SELECT p.mask_id, p.c, sqrt(dr.tx * dr.tx + dr.ty * dr.ty) AS len, p.x * (p.y + dr.ty) - (p.x + dr.tx) * p.y AS turn FROM co p, dr JOIN co q ON q.mask_id = p.mask_id AND q.x = p.x + dr.tx AND q.y = p.y + dr.ty
  JOIN ou o ON o.mask_id = p.mask_id AND o.x = p.x + dr.ox AND o.y = p.y + dr.oy LEFT JOIN ou o2 ON o2.mask_id = p.mask_id AND o2.x = p.x + dr.ox + dr.tx AND o2.y = p.y + dr.oy + dr.ty WHERE dr.tx * dr.ty <> 0 OR o2.mask_id IS NOT NULL),
bo AS (SELECT mask_id, c, sum(len) AS len, abs(sum(turn)) / 2 AS enclosed FROM mv GROUP BY ALL),
pe AS (SELECT mask_id, arg_max(len, (enclosed, len)) AS perimeter FROM bo GROUP BY mask_id),
so AS (SELECT i.mask_id, max(CASE WHEN gx <> 0 OR gy <> 0 THEN 1.0 ELSE 0.0 END) AS edge FROM (SELECT a.mask_id, a.px, a.py, sum(CASE WHEN m.logit > 0 THEN w.dx * w.wy ELSE 0 END) AS gx, sum(CASE WHEN m.logit > 0 THEN w.dy * w.wx ELSE 0 END) AS gy
  FROM px a, (SELECT dx, dy, 2 - abs(dx) AS wx, 2 - abs(dy) AS wy FROM (VALUES (-1), (0), (1)) u(dx), (VALUES (-1), (0), (1)) v(dy)) w JOIN px m ON m.mask_id = a.mask_id AND m.px = 7 - abs(7 - abs(a.px + w.dx)) AND m.py = 7 - abs(7 - abs(a.py + w.dy)) GROUP BY a.mask_id, a.px, a.py) i GROUP BY i.mask_id),
sh AS (SELECT i.mask_id, coalesce(perimeter, 0.0) AS perimeter, CASE WHEN perimeter > 0 THEN least(1.0, 4 * pi() * area / perimeter ** 2) ELSE 0.0 END AS compactness, coalesce(k, 0) AS n_components, CASE WHEN k > 5 THEN 0.0 ELSE 1.0 / greatest(1, coalesce(k, 0)) END AS fragmentation, edge
  FROM ids i JOIN e USING (mask_id) JOIN so USING (mask_id) LEFT JOIN pe USING (mask_id) LEFT JOIN (SELECT mask_id, count(DISTINCT c) AS k FROM co GROUP BY mask_id) n USING (mask_id))"""

ORACLE_SQL = {
    "mask_stats": f"""WITH {_ST}, o AS (SELECT mask_id, frame, area, round(area / size, 6) AS coverage, round(cx, 6) AS cx, round(cy, 6) AS cy, round(coalesce(1 / (1 + exp(-strength)), 0), 6) AS confidence, round(coalesce(exp(-spread / 2), 0), 6) AS depth_consistency,
round(CASE WHEN area < 2 THEN 0.0 WHEN hi <= 1e-6 THEN 1.0 WHEN lo <= 0 THEN 0.0 ELSE exp(-0.5 * power(ln(sqrt(hi / lo)), 2)) END, 6) AS aspect FROM e)
SELECT *, round(CASE WHEN coverage < 0.001 OR coverage > 0.95 THEN 0.0 WHEN coverage < 0.01 THEN (coverage - 0.001) / 0.009 WHEN coverage > 0.3 THEN 1 - (coverage - 0.3) / 0.65 ELSE 1.0 END, 6) AS coverage_score FROM o""",
    "mask_shape": f"WITH RECURSIVE {_SHAPE} SELECT mask_id, round(perimeter, 6) AS perimeter, round(compactness, 6) AS compactness, n_components::INTEGER AS n_components, round(fragmentation, 6) AS fragmentation, edge::DOUBLE AS edge FROM sh",
    "mask_quality": f"""WITH RECURSIVE {_SHAPE}, q AS (SELECT mask_id, frame, area / size AS coverage, compactness, edge::DOUBLE AS edge, fragmentation, n_components, CASE WHEN area < 2 THEN 0.0 WHEN hi <= 1e-6 THEN 1.0 WHEN lo <= 1e-12 * hi THEN 0.0 ELSE exp(-0.5 * power(ln(sqrt(hi / lo)), 2)) END AS aspect FROM e JOIN sh USING (mask_id)),
w AS (SELECT *, 0.15 * CASE WHEN coverage < 0.001 OR coverage > 0.95 THEN 0.0 WHEN coverage < 0.01 THEN (coverage - 0.001) / 0.009 WHEN coverage > 0.3 THEN 1 - (coverage - 0.3) / 0.65 ELSE 1.0 END + 0.3 * compactness + 0.2 * edge + 0.2 * fragmentation + 0.15 * aspect AS overall FROM q)
SELECT mask_id, frame, round(coverage, 6) AS coverage, round(compactness, 6) AS compactness, edge, round(fragmentation, 6) AS fragmentation, round(aspect, 6) AS aspect, round(overall, 6) AS overall, coverage BETWEEN 0.001 AND 0.95 AND compactness >= 0.1 AND edge >= 0.2 AND n_components <= 5 AND overall >= 0.4 AS is_valid FROM w""",
    "depth_confidence": f"""WITH {SQL['px']}, dp AS (SELECT mask_id, px, py, 5 + 10 * logit BETWEEN 0.1 AND 100 AS ok, greatest(0.1::DOUBLE, least(100.0::DOUBLE, 5 + 10 * logit)) AS v FROM px),
mi AS (SELECT i, k, CASE WHEN i + k < 0 THEN -1 - i - k WHEN i + k > 7 THEN 15 - i - k ELSE i + k END AS j FROM range(8) a(i), range(-2, 3) b(k)),
bx AS (SELECT a.mask_id, a.px, a.py, greatest(0.0, avg(n.v * n.v) - avg(n.v) ** 2) AS spread FROM dp a JOIN mi x ON x.i = a.px JOIN mi y ON y.i = a.py JOIN dp n ON n.mask_id = a.mask_id AND n.px = x.j AND n.py = y.j GROUP BY ALL),
gd AS (SELECT *, (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / CASE WHEN px IN (0, 7) THEN 1 ELSE 2 END AS gx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / CASE WHEN py IN (0, 7) THEN 1 ELSE 2 END AS gy
  FROM dp WINDOW r AS (PARTITION BY mask_id, py ORDER BY px), c AS (PARTITION BY mask_id, px ORDER BY py)),
un AS (SELECT mask_id, ok, v, u, max(u) OVER (PARTITION BY mask_id) AS top FROM (SELECT g.*, spread + 0.5 * sqrt(gx * gx + gy * gy) AS u FROM gd g JOIN bx USING (mask_id, px, py)) q),
uc AS (SELECT mask_id, ok, v, CASE WHEN NOT ok THEN 1.0 WHEN top > 0 THEN u / top ELSE u END AS u FROM un)
SELECT mask_id, round(avg(ok::INT), 6) AS valid_ratio, round(avg(u), 6) AS mean_uncertainty, round(CASE WHEN bool_or(ok) THEN 0.5 * (1 - avg(u) FILTER (ok)) + 0.3 * avg(ok::INT) + 0.2 * (1 - least(1.0, stddev_pop(v) FILTER (ok) / 50)) ELSE 0.0 END, 6) AS confidence FROM uc GROUP BY mask_id""",
    "motion_magnitude": f"""WITH fr AS (SELECT vec_id, label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS e, vec_id % 29 <> 0 AS ok FROM embeddings),
an AS (SELECT *, coalesce(bool_and(ok) OVER (PARTITION BY video ORDER BY frame), true) AS live FROM fr WHERE frame % 5 = 0),
gp AS (SELECT video, frame, (i - 1) % 8 AS x, (i - 1) // 8 AS y, e[i]::DOUBLE AS v FROM an, range(1, 65) r(i) WHERE live),
gr AS (SELECT *, (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / CASE WHEN x IN (0, 7) THEN 1 ELSE 2 END AS gx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / CASE WHEN y IN (0, 7) THEN 1 ELSE 2 END AS gy
  FROM gp WINDOW r AS (PARTITION BY video, frame, y ORDER BY x), c AS (PARTITION BY video, frame, x ORDER BY y)),
pr AS (SELECT b.video, b.frame, b.x, b.y, (a.gx + b.gx) / 2 AS gx, (a.gy + b.gy) / 2 AS gy, b.v - a.v AS gt FROM gr b JOIN gr a ON a.video = b.video AND a.frame = b.frame - 5 AND a.x = b.x AND a.y = b.y),
mi AS (SELECT i, CASE WHEN i + k < 0 THEN -1 - i - k WHEN i + k > 7 THEN 15 - i - k ELSE i + k END AS j FROM range(8) a(i), range(-2, 3) b(k)),
sm AS (SELECT p.video, p.frame, p.x, p.y, sum(n.gx * n.gx) AS a, sum(n.gx * n.gy) AS b, sum(n.gy * n.gy) AS c, sum(n.gx * n.gt) AS d, sum(n.gy * n.gt) AS e FROM pr p JOIN mi mx ON mx.i = p.x JOIN mi my ON my.i = p.y JOIN pr n ON n.video = p.video AND n.frame = p.frame AND n.x = mx.j AND n.y = my.j GROUP BY ALL),
mg AS (SELECT video, frame, avg(CASE WHEN a * c - b * b > 1e-6 * (a + c) ** 2 THEN sqrt(((b * e - c * d) / (a * c - b * b)) ** 2 + ((b * d - a * e) / (a * c - b * b)) ** 2) ELSE 0.0 END) AS score FROM sm GROUP BY ALL)
SELECT an.video, an.frame::INTEGER AS frame, round(coalesce(score, 0.0), 6) AS score FROM an LEFT JOIN mg ON mg.video = an.video AND mg.frame = an.frame""",
    "mask_weighted_centroid": f"WITH {SQL['px']} SELECT mask_id, round(sum(px * logit) FILTER (logit > 0) / sum(logit) FILTER (logit > 0), 6) AS x, round(sum(py * logit) FILTER (logit > 0) / sum(logit) FILTER (logit > 0), 6) AS y FROM px GROUP BY mask_id",
    "mask_box_iou": f"""WITH {SQL['px']}, b AS (SELECT *, greatest(0, trunc(mask_id % 5 - 0.5)) AS x0, trunc(mask_id % 5 - 0.5) + mask_id % 7 AS x1, mask_id % 3 AS y0, mask_id % 3 + 4 AS y1 FROM px), c AS (SELECT mask_id, logit > 0 AS m, px >= x0 AND px < least(8, x1) AND py >= y0 AND py < least(8, y1) AS k FROM b)
SELECT mask_id, round(CASE WHEN count(*) FILTER (m OR k) = 0 THEN 0.0 ELSE count(*) FILTER (m AND k) / count(*) FILTER (m OR k) END, 6) AS iou FROM c GROUP BY mask_id""",
    "mask_depth_point": f"""WITH {_ST}, f AS (SELECT mask_id, cx, cy, floor(cx) AS x0, floor(cy) AS y0 FROM g WHERE area > 0)
SELECT f.mask_id, round(any_value(cx), 6) AS x, round(any_value(cy), 6) AS y, round(sum(depth * (CASE WHEN px = x0 THEN 1 - (cx - x0) ELSE cx - x0 END) * (CASE WHEN py = y0 THEN 1 - (cy - y0) ELSE cy - y0 END)), 6) AS z
FROM f JOIN px ON px.mask_id = f.mask_id AND px.px BETWEEN x0 AND x0 + 1 AND px.py BETWEEN y0 AND y0 + 1 GROUP BY f.mask_id""",
    "nms": f"WITH {_NMS} SELECT frame, b.ord::INTEGER AS ord, round(b.c, 6) AS confidence FROM n1",
    "retention": f"WITH {_NMS} SELECT (SELECT count(*) FROM dt) AS total, count(*) AS kept, round(count(*) / (SELECT count(*) FROM dt), 6) AS ratio FROM n1",
    "temporal_mask_filter": f"""WITH RECURSIVE {_BITS}, o AS (SELECT frame AS obj_id, row_number() OVER (PARTITION BY frame ORDER BY mask_id) - 1 AS pos, bits FROM bt),
r AS (SELECT obj_id, pos, bits, true AS keep FROM o WHERE pos = 0 UNION ALL SELECT o.obj_id, o.pos, CASE WHEN k.ok THEN o.bits ELSE r.bits END, k.ok FROM r JOIN o ON o.obj_id = r.obj_id AND o.pos = r.pos + 1, LATERAL (SELECT bit_count(r.bits & o.bits) / bit_count(r.bits | o.bits) >= 0.3 AS ok) k)
SELECT obj_id, pos::INTEGER AS pos FROM r WHERE keep""",
}
