"""Mask, consistency and fusion queries on 8 x 8 videos made of embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumentrack.operators import fusion as fu
from lumentrack.operators import masks as mk
from lumentrack.operators import semantic as ml
from lumentrack.plans.trajectory import smooth_sql
from lumentrack.sources.adapters import r6, rasters
from lumentrack.sources.store import home, stored
from lumentrack.sources.tables import table
from lumentrack.streaming import sink

FPS, DEPTH_CONFIDENCE, SEMANTIC_CONFIDENCE = 10.0, 0.8, 0.9


def _masks(spark, d):
    """An embedding is the mask of the object of its label on the label's next frame; objects belong to two videos. Every seventh has no confidence."""
    r = rasters(table(spark, d, "embeddings"))
    order = Window.partitionBy("frame").orderBy("mask_id")
    strength = F.expr("aggregate(filter(logits, v -> v > 0), 0D, (t, v) -> t + v)") / F.size(F.filter("logits", lambda v: v > 0))
    return r.select(
        (F.col("frame") % 2).alias("video"), F.col("frame").cast("long").alias("obj_id"), "mask_id", (F.row_number().over(order) - 1).cast("long").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), mk.runs(F.col("logits"), 8).alias("runs"),
        F.when(F.col("mask_id") % 7 != 0, 1 / (1 + F.exp(-strength))).alias("confidence"), "logits",
    )


def _scene(spark, d):
    """Masks; depth maps by position, those of the video's first object on each of its frames; every second frame of each video, sampled; and the regions as boxes, the first of which has none.

    The masks are written once, as they are a sort of the whole table and are read for each of the others.
    """
    m = stored(_masks(spark, d), "masks")
    depth = m.where("obj_id < 2").select(F.col("obj_id").cast("int").alias("video"), F.col("frame").alias("pos"), F.transform("logits", lambda v: F.greatest(F.lit(0.1), F.least(F.lit(100.0), 5 + 10 * v))).alias("depth"))
    pos = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 2)))
    sampled = m.groupBy("video").agg(F.max("frame").alias("last")).select("video", pos.alias("pos")).withColumn("frame", F.col("pos") * 2)
    key = F.col("r_regionkey")
    box = F.when(key > 0, F.struct(key.cast("double").alias("x"), (key % 3).cast("double").alias("y"), F.lit(4.0).alias("w"), F.lit(5.0).alias("h")))
    boxes = table(spark, d, "region").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("video"), key.alias("ord"), F.lower("r_name").alias("label"), box.alias("box"))
    return m.drop("logits"), depth, sampled, boxes


def _fused(spark, d):
    scene = _scene(spark, d)
    return fu.fuse(*scene, FPS, 8, 8, DEPTH_CONFIDENCE, SEMANTIC_CONFIDENCE), scene


def fused_objects(spark, d):
    """Objects of both videos from masks, depth maps and boxes."""
    o = _fused(spark, d)[0]
    doubles = [f.name for f in o.schema.fields if f.dataType.simpleString() == "double"]
    return o.withColumns({c: r6(F.col(c)) for c in doubles})


def fused_points(spark, d):
    """Raw points of the fusion, with their consistency."""
    p = fu.points(*_scene(spark, d), FPS, 8, 8)
    return p.select("obj_id", "pos", "frame", *[r6(F.col(c)).alias(c) for c in ("t", "x", "y", "z", "coverage", "score")])


def fused_documents(spark, d):
    """A JSON document an object, with its scene's size; rows, so that a scene of any size is spread over tasks."""
    o = stored(_fused(spark, d)[0].select("object_id", "label", "n_points", "behaviour"), "fused-objects")
    scene = o.groupBy("behaviour").agg(F.count("*").alias("n_alike"))
    doc = F.to_json(F.struct("object_id", "label", "n_points", "behaviour"))
    return o.join(scene, "behaviour").select("object_id", "n_alike", doc.alias("document"))


def stored_documents(spark, d):
    """Every object's document with its trajectory, written to the JSON sink batch by batch (a batch a video, the first of them twice) and read back from its files."""
    o, scene = _fused(spark, d)
    raw = fu.points(*scene, FPS, 8, 8).select(F.concat(F.lit("track_"), F.col("obj_id")).alias("object_id"), "pos", "t", "x", "y", "z")
    rows = sink.with_geometry(o.select("video", "object_id", "label", "behaviour"), raw, "object_id", ["t", "x", "y", "z"])
    rows = stored(rows.select("video", F.concat(F.lit("job_"), F.col("video")).alias("job_id"), "object_id", sink.document("label", "behaviour", "trajectory").alias("document")), "documents")
    folder = home(spark, "results")
    for batch in (0, 1, 0):
        sink.write_batch(rows.where(F.col("video") == batch), batch, folder)
    found = sink.read_documents(spark, folder).withColumn("d", F.from_json("document", "label string, behaviour string, trajectory array<struct<t:double,x:double,y:double,z:double>>"))
    last = F.element_at("d.trajectory", -1)
    return found.select("job_id", "object_id", "d.label", "d.behaviour", F.size("d.trajectory").alias("n_points"), *[r6(last[c]).alias(f"last_{c}") for c in "txyz"])


def filtered_results(spark, d):
    """Stored nested results by three filters: reliable, with violations, well labelled."""
    results = stored(fu.nested(_fused(spark, d)[0]), "results")
    kinds = {"reliable": fu.reliable(results, 0.46), "violating": fu.violating(results), "well_labelled": fu.well_labelled(results, 0.47)}
    found = None
    for name, rows in kinds.items():
        own = rows.select("object_id", "semantic.label", F.lit(name).alias("filter"))
        found = own if found is None else found.unionByName(own)
    return found


def fusion_result(spark, d):
    """The enriched result row of each video's job."""
    o, (_, _, sampled, _) = _fused(spark, d)
    job = F.concat(F.lit("job_"), F.col("video")).alias("job_id")
    sampling = sampled.groupBy(job).agg(F.count("*").alias("sampled_frames")).withColumn("sampling_strategy", F.lit("uniform_fallback"))
    out = fu.results(o.withColumn("job_id", job), sampling, DEPTH_CONFIDENCE, SEMANTIC_CONFIDENCE)
    return out.withColumns({c: r6(F.col(c)) for c in ("mask_avg_confidence", "complexity")})


def mask_consistency(spark, d):
    """Every mask against a depth map of its own logits and a box by its number; every fifth has no box."""
    m = _masks(spark, d)
    box = F.when(F.col("mask_id") % 5 != 0, F.struct((F.col("mask_id") % 5 - 0.5).alias("x"), (F.col("mask_id") % 3).cast("double").alias("y"), (F.col("mask_id") % 7 + 0.9).alias("w"), F.lit(4.2).alias("h")))
    rows = fu.consistency(m.withColumn("box", box).withColumn("depth", F.col("logits")), 8, 8)
    names = ("spatial_iou", "centroid_distance", "depth_consistency", "overall_consistency")
    return rows.select("mask_id", *[r6(F.col(c)).alias(c) for c in names], "is_consistent")


def consistent_masks(spark, d):
    return fu.consistent(mask_consistency(spark, d), least=0.55).select("mask_id", "overall_consistency")


def mask_label_match(spark, d):
    """Objects' first masks against all boxes of their video."""
    m, _, _, boxes = _scene(spark, d)
    first = m.where("frame = 0")
    return ml.best_match(fu.spatial_pairs(first, boxes, 8, 8), first.select("obj_id")).withColumn("confidence", r6(F.col("confidence")))


def mask_nms(spark, d):
    """The masks of a label as detections on one frame; their confidence falls back to a half."""
    m = _masks(spark, d).select(F.col("obj_id").alias("frame"), F.col("mask_id").alias("obj_id"), F.col("mask_id").alias("ord"), "height", "width", "runs", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    return mk.nms(mk.min_area(m, 0.3), 0.35)


def mask_pair_iou(spark, d):
    """Pairs of masks of a label that overlap by more than two fifths."""
    m = _masks(spark, d).select(F.col("obj_id").alias("frame"), F.col("mask_id").alias("obj_id"), "runs")
    return mk.overlaps(m, 0.4).withColumn("iou", r6(F.col("iou")))


def quality_mask_filter(spark, d):
    """Masks of an object over time: those of two to three fifths of the frame are valid, and stay if they overlap the last kept one."""
    share = mk.area(F.col("runs")) / 64
    return mk.temporal_filter(_masks(spark, d).withColumn("is_valid", share.between(0.4, 0.6)), 0.3)


QUERIES = {f.__name__: f for f in (fused_objects, fused_points, fused_documents, stored_documents, filtered_results, fusion_result, mask_consistency, consistent_masks, mask_label_match, mask_nms, mask_pair_iou, quality_mask_filter)}

_RA = "ra AS (SELECT vec_id, label::BIGINT AS obj_id, label % 2 AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS e FROM embeddings)"
_MP = f"""{_RA}, pl AS (SELECT i + 1 AS k, i % 8 AS px, i // 8 AS py FROM range(64) r(i)),
mp AS (SELECT vec_id, obj_id, video, frame, k, px, py, e[k] > 0 AS m, e[k]::DOUBLE AS logit, greatest(0.1::DOUBLE, least(100.0::DOUBLE, 5 + 10 * e[k]::DOUBLE)) AS depth FROM ra, pl)"""
_CONF = "1 / (1 + exp(-avg(logit) FILTER (m)))"
_FIRST = """bx AS (SELECT r_regionkey AS ord, lower(r_name) AS label, r_regionkey AS x, r_regionkey % 3 AS y FROM region WHERE r_regionkey > 0),
mt AS (SELECT obj_id, ord, label, count(*) FILTER (m AND b) / count(*) FILTER (m OR b) AS iou FROM (SELECT obj_id, ord, label, m, px >= x AND px < x + 4 AND py >= y AND py < y + 5 AS b FROM mp, bx WHERE frame = 0) q GROUP BY 1, 2, 3),
nm AS (SELECT obj_id, arg_max(label, (c, -ord)) AS label, max(c) AS c FROM (SELECT *, least(1.0, 1.2::DOUBLE * iou) AS c FROM mt WHERE iou >= 0.3) q GROUP BY obj_id),
lb AS (SELECT o.obj_id, coalesce(label, 'object_' || o.obj_id) AS label, coalesce(c, 0.5) AS label_confidence, CASE WHEN c IS NULL THEN 'fallback' ELSE 'spatial' END AS method FROM (SELECT DISTINCT obj_id FROM mp WHERE frame = 0) o LEFT JOIN nm ON nm.obj_id = o.obj_id)"""
# sa: sampled positions; sm0: sampled masks, a row a pixel; dp: depth by position; mm: both, with the box; pa: a row a point; zz: depth at the centroid.
_POINTS = f"""{_MP}, sa AS (SELECT video, unnest(range(0, last // 2 + 1)) AS seq FROM (SELECT video, max(frame) AS last FROM ra GROUP BY video) q),
sm0 AS (SELECT mp.*, seq FROM mp JOIN sa ON sa.video = mp.video AND 2 * sa.seq = mp.frame),
dp AS (SELECT obj_id AS video, frame AS seq, k, depth AS d FROM mp WHERE obj_id < 2),
mm AS (SELECT s.*, d, px >= 1 AND px < 5 AND py >= 1 AND py < 6 AS b FROM sm0 s JOIN dp ON dp.video = s.video AND dp.seq = s.seq AND dp.k = s.k),
pa AS (SELECT obj_id, any_value(video) AS video, seq, any_value(frame) AS frame, count(*) FILTER (m) AS area, avg(px) FILTER (m) AS x, avg(py) FILTER (m) AS y, var_pop(d) FILTER (m) AS dv, count(*) FILTER (m AND b) / count(*) FILTER (m OR b) AS iou FROM mm GROUP BY obj_id, seq HAVING count(*) FILTER (m) > 0),
zz AS (SELECT p.obj_id, p.seq, sum(d * CASE WHEN px = floor(p.x) THEN 1 - (p.x - floor(p.x)) ELSE p.x - floor(p.x) END * CASE WHEN py = floor(p.y) THEN 1 - (p.y - floor(p.y)) ELSE p.y - floor(p.y) END) AS z
  FROM pa p JOIN mm ON mm.obj_id = p.obj_id AND mm.seq = p.seq AND px BETWEEN floor(p.x) AND floor(p.x) + 1 AND py BETWEEN floor(p.y) AND floor(p.y) + 1 GROUP BY 1, 2),
pt AS (SELECT p.obj_id, row_number() OVER (PARTITION BY p.obj_id ORDER BY p.seq) - 1 AS pos, frame, round(frame / 10, 3) AS t, p.x, p.y, z, area / 64 AS coverage,
  greatest(0.0, least(1.0, 0.4 * iou + 0.3 * (1 - least(1.0, sqrt((p.x - 3) ** 2 + (p.y - 3.5) ** 2) / sqrt(128) / 0.2)) + 0.3 * least(1.0, exp(-dv / 2)))) AS score FROM pa p JOIN zz ON zz.obj_id = p.obj_id AND zz.seq = p.seq)"""
_W = "OVER (PARTITION BY obj_id ORDER BY pos)"
# cp: metres; s1: speed clamp; a1: acceleration clamp; tn: turns; mo: motion; va: extents; fs: fast points; tc: temporal consistency;
# mc: confidence over sampled frames; qm: over all frames; fo: objects.
_FUSED = f"""{_POINTS}, {_FIRST}, {smooth_sql('pt', 'score')},
cp AS (SELECT obj_id, pos, t, x * 0.01 AS x, y * 0.01 AS y, z FROM sm),
s1 AS (SELECT obj_id, pos, t, x, y, z, false AS hit FROM cp WHERE pos = 0
  UNION ALL SELECT obj_id, pos, t, CASE WHEN gap / dt > 20 THEN rx + (x - rx) * 20 * dt / gap ELSE x END, CASE WHEN gap / dt > 20 THEN ry + (y - ry) * 20 * dt / gap ELSE y END, CASE WHEN gap / dt > 20 THEN rz + (z - rz) * 20 * dt / gap ELSE z END, gap / dt > 20
  FROM (SELECT c.*, r.x AS rx, r.y AS ry, r.z AS rz, sqrt((c.x - r.x) ** 2 + (c.y - r.y) ** 2 + (c.z - r.z) ** 2) AS gap, CASE WHEN c.t > r.t THEN c.t - r.t ELSE 0.033::DOUBLE END AS dt FROM s1 r JOIN cp c ON c.obj_id = r.obj_id AND c.pos = r.pos + 1) g),
a1 AS (SELECT obj_id, pos, t, x, y, z, NULL::DOUBLE AS t0, NULL::DOUBLE AS x0, NULL::DOUBLE AS y0, NULL::DOUBLE AS z0, false AS hit FROM s1 WHERE pos = 0
  UNION ALL SELECT obj_id, pos, t, CASE WHEN m > 20 THEN qx + (vx + ax * 20 / m * d2) * d2 ELSE x END, CASE WHEN m > 20 THEN qy + (vy + ay * 20 / m * d2) * d2 ELSE y END, CASE WHEN m > 20 THEN qz + (vz + az * 20 / m * d2) * d2 ELSE z END, qt, qx, qy, qz, coalesce(m > 20, false)
  FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS m FROM (SELECT *, ((x - qx) / d2 - vx) / d2 AS ax, ((y - qy) / d2 - vy) / d2 AS ay, ((z - qz) / d2 - vz) / d2 AS az
    FROM (SELECT c.obj_id, c.pos, c.t, c.x, c.y, c.z, p.t AS qt, p.x AS qx, p.y AS qy, p.z AS qz, CASE WHEN p.t > p.t0 AND c.t > p.t THEN c.t - p.t END AS d2, (p.x - p.x0) / CASE WHEN p.t > p.t0 THEN p.t - p.t0 END AS vx, (p.y - p.y0) / CASE WHEN p.t > p.t0 THEN p.t - p.t0 END AS vy, (p.z - p.z0) / CASE WHEN p.t > p.t0 THEN p.t - p.t0 END AS vz
      FROM a1 p JOIN s1 c ON c.obj_id = p.obj_id AND c.pos = p.pos + 1) b1) b2) b3),
tn AS (SELECT obj_id, count(*) FILTER (la > 0 AND lb > 0 AND dot / (la * lb) < -0.5) AS n FROM (SELECT obj_id, sqrt(ux * ux + uy * uy) AS la, sqrt(wx * wx + wy * wy) AS lb, ux * wx + uy * wy AS dot
  FROM (SELECT obj_id, lag(x) {_W} - lag(x, 2) {_W} AS ux, lag(y) {_W} - lag(y, 2) {_W} AS uy, x - lag(x) {_W} AS wx, y - lag(y) {_W} AS wy FROM a1) c1) c2 GROUP BY obj_id),
mo AS (SELECT obj_id, count(*) AS n_points, arg_max(t, pos) - arg_min(t, pos) AS duration, avg(speed) AS mean_speed, avg(score) AS consistency,
  CASE WHEN count(*) < 3 OR sqrt(dd) < 0.1 THEN 'stationary' WHEN sqrt(dd) / (coalesce(sum(step), 0) + 1e-6) > 0.9 THEN 'linear' WHEN sqrt(dd) / (coalesce(sum(step), 0) + 1e-6) > 0.5 THEN 'parabolic' ELSE 'erratic' END AS behaviour
  FROM (SELECT *, power(last_value(x) OVER w - first_value(x) OVER w, 2) + power(last_value(y) OVER w - first_value(y) OVER w, 2) + power(last_value(z) OVER w - first_value(z) OVER w, 2) AS dd, sqrt((x - lag(x) {_W}) ** 2 + (y - lag(y) {_W}) ** 2 + (z - lag(z) {_W}) ** 2) AS step,
    sqrt(coalesce(vx, 0) ** 2 + coalesce(vy, 0) ** 2 + coalesce(vz, 0) ** 2) AS speed FROM sm WINDOW w AS (PARTITION BY obj_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) d1 GROUP BY obj_id, dd),
va AS (SELECT obj_id, {', '.join(f'{k}({c}) AS {k}_{c}' for c in 'xyz' for k in ('min', 'max'))}, sqrt(power(arg_max(x, pos) - arg_min(x, pos), 2) + power(arg_max(y, pos) - arg_min(y, pos), 2) + power(arg_max(z, pos) - arg_min(z, pos), 2)) AS displacement, count(*) FILTER (hit) AS n_hard
  FROM (SELECT obj_id, pos, x * 100 AS x, y * 100 AS y, z, hit FROM a1) e1 GROUP BY obj_id),
fs AS (SELECT obj_id, count(*) FILTER (hit) AS n_fast FROM s1 GROUP BY obj_id),
tc AS (SELECT obj_id, coalesce(1 - least(1.0, 2 * var_pop(r)), 1.0) AS tc FROM (SELECT obj_id, CASE WHEN pos >= 4 THEN avg(score) OVER (PARTITION BY obj_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS r FROM sm) f1 GROUP BY obj_id),
mc AS (SELECT obj_id, any_value(video) AS video, coalesce(avg(c), 0.5) AS mask_confidence FROM (SELECT obj_id, any_value(video) AS video, CASE WHEN vec_id % 7 <> 0 THEN {_CONF} END AS c FROM sm0 GROUP BY obj_id, seq, vec_id) g1 GROUP BY obj_id),
qm AS (SELECT obj_id, coalesce(avg(c), 0.0) AS avg_confidence, count(c) AS tracking_frames FROM (SELECT obj_id, CASE WHEN vec_id % 7 <> 0 THEN {_CONF} END AS c FROM mp GROUP BY obj_id, vec_id) g2 GROUP BY obj_id),
fo AS (SELECT mc.video, 'track_' || mo.obj_id AS object_id, label, round(label_confidence, 6) AS label_confidence, method, behaviour, CASE WHEN n_points > 10 THEN 'high' ELSE 'medium' END AS tracking_confidence, n_points, round(duration, 6) AS duration, round(displacement, 6) AS displacement, round(mean_speed, 6) AS mean_speed,
  {', '.join(f'round({k}_{c}, 6) + 0.0 AS {k}_{c}' for c in 'xyz' for k in ('min', 'max'))}, round(mask_confidence, 6) AS mask_confidence, round(avg_confidence, 6) AS avg_confidence, tracking_frames, round(consistency, 6) AS consistency, round(tc, 6) AS temporal_consistency,
  round(CASE WHEN mask_confidence <> 0 THEN least(1.0, power(mask_confidence, 0.4) * power(0.8, 0.3) * power(0.9, 0.3) * (0.5 + 0.5 * consistency)) ELSE 0.7 END, 6) AS confidence, CASE WHEN n_points < 2 THEN 0 ELSE n_fast + n_hard + tn.n END AS total_violations,
  CASE WHEN n_points < 2 THEN 'too_short' WHEN n_fast + n_hard + tn.n = 0 THEN 'valid' ELSE 'invalid' END AS physics_status
  FROM mo JOIN va ON va.obj_id = mo.obj_id JOIN fs ON fs.obj_id = mo.obj_id JOIN tn ON tn.obj_id = mo.obj_id JOIN tc ON tc.obj_id = mo.obj_id JOIN mc ON mc.obj_id = mo.obj_id JOIN qm ON qm.obj_id = mo.obj_id JOIN lb ON lb.obj_id = mo.obj_id)"""
_AGREE = f"""{_MP}, cb AS (SELECT *, vec_id % 5 <> 0 AS has, vec_id % 5 - 0.5 AS bx, vec_id % 3 AS by0, vec_id % 7 + 0.9 AS bw FROM mp),
cm AS (SELECT *, has AND px >= greatest(0, trunc(bx)) AND px < least(8, trunc(bx) + trunc(bw)) AND py >= by0 AND py < by0 + 4 AS b FROM cb),
cg AS (SELECT vec_id AS mask_id, any_value(has) AS has, any_value(bx + bw / 2) AS cx, any_value(by0 + 2.1) AS cy, coalesce(avg(px) FILTER (m), 0) AS x, coalesce(avg(py) FILTER (m), 0) AS y, count(*) FILTER (m AND b) AS i, count(*) FILTER (m OR b) AS u, var_pop(logit) FILTER (m) AS dv FROM cm GROUP BY vec_id),
cd AS (SELECT mask_id, CASE WHEN NOT has THEN 1.0 WHEN u = 0 THEN 0.0 ELSE i / u END AS iou, CASE WHEN NOT has THEN 0.0 ELSE sqrt((x - cx) ** 2 + (y - cy) ** 2) / sqrt(128) END AS dist, coalesce(least(1.0, exp(-dv / 2)), 0.0) AS dc FROM cg),
ce AS (SELECT *, greatest(0.0, least(1.0, 0.4 * iou + 0.3 * (1 - least(1.0, dist / 0.2)) + 0.3 * dc)) AS overall FROM cd)"""

ORACLE_SQL = {
    "fused_objects": f"WITH RECURSIVE {_FUSED} SELECT * FROM fo",
    "fused_points": f"WITH {_POINTS} SELECT obj_id, pos, frame, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('t', 'x', 'y', 'z', 'coverage', 'score'))} FROM pt",
    "fused_documents": f"""WITH RECURSIVE {_FUSED} SELECT object_id, count(*) OVER (PARTITION BY behaviour) AS n_alike, '{{"object_id":"' || object_id || '","label":"' || label || '","n_points":' || n_points || ',"behaviour":"' || behaviour || '"}}' AS document FROM fo""",
    "stored_documents": f"""WITH RECURSIVE {_FUSED} SELECT 'job_' || video AS job_id, object_id, label, behaviour, n_points::INTEGER AS n_points, round(p.t, 6) AS last_t, round(p.x, 6) + 0.0 AS last_x, round(p.y, 6) + 0.0 AS last_y, round(p.z, 6) + 0.0 AS last_z
FROM fo JOIN pt p ON 'track_' || p.obj_id = object_id AND p.pos = n_points - 1""",
    "filtered_results": f"""WITH RECURSIVE {_FUSED} SELECT object_id, label, 'reliable' AS filter FROM fo WHERE consistency > 0.46 UNION ALL SELECT object_id, label, 'violating' FROM fo WHERE total_violations > 0 UNION ALL SELECT object_id, label, 'well_labelled' FROM fo WHERE label_confidence > 0.47""",
    "fusion_result": f"""WITH RECURSIVE {_FUSED}, jb AS (SELECT video, count(*) AS total_objects, arg_min(behaviour, object_id) <> 'stationary' AS dynamic FROM fo GROUP BY video),
ac AS (SELECT video, avg(c) AS c FROM (SELECT video, CASE WHEN vec_id % 7 <> 0 THEN {_CONF} END AS c FROM mp GROUP BY video, vec_id) q GROUP BY video)
SELECT 'job_' || s.video AS job_id, 'success' AS status, total_objects, round(ac.c, 6) AS mask_avg_confidence, dynamic, round(total_objects * count(*) / 100, 6) AS complexity, 'uniform_fallback' AS sampling_strategy, count(*) AS sampled_frames, 0.8::DOUBLE AS depth_avg_confidence, 0.9::DOUBLE AS semantic_confidence
FROM sa s JOIN jb ON jb.video = s.video JOIN ac ON ac.video = s.video GROUP BY s.video, total_objects, ac.c, dynamic""",
    "mask_consistency": f"WITH {_AGREE} SELECT mask_id, round(iou, 6) AS spatial_iou, round(dist, 6) AS centroid_distance, round(dc, 6) AS depth_consistency, round(overall, 6) AS overall_consistency, iou >= 0.3 AND dist <= 0.2 AND overall >= 0.5 AS is_consistent FROM ce",
    "consistent_masks": f"WITH {_AGREE} SELECT mask_id, round(overall, 6) AS overall_consistency FROM ce WHERE round(overall, 6) >= 0.55",
    "mask_label_match": f"WITH {_MP}, {_FIRST} SELECT obj_id, label, round(label_confidence, 6) AS confidence, method FROM lb",
    "mask_nms": f"""WITH RECURSIVE {_MP}, ms AS (SELECT obj_id AS frame, vec_id, string_agg(CASE WHEN m THEN '1' ELSE '0' END, '' ORDER BY k)::BIT AS bits, count(*) FILTER (m) AS area, CASE WHEN vec_id % 7 <> 0 THEN {_CONF} ELSE 0.5 END AS c FROM mp GROUP BY obj_id, vec_id HAVING count(*) FILTER (m) >= 0.3 * 64),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY c DESC, vec_id) AS n FROM ms),
kp AS (SELECT frame, n, [bits] AS kept, vec_id AS found FROM rk WHERE n = 1 UNION ALL SELECT r.frame, r.n, CASE WHEN o.bad > 0 THEN k.kept ELSE list_append(k.kept, r.bits) END, CASE WHEN o.bad > 0 THEN NULL ELSE r.vec_id END
  FROM kp k JOIN rk r ON r.frame = k.frame AND r.n = k.n + 1, LATERAL (SELECT len(list_filter(k.kept, lambda z: bit_count(z & r.bits) > 0.35 * bit_count(z | r.bits))) AS bad) o)
SELECT frame, found AS obj_id FROM kp WHERE found IS NOT NULL""",
    "mask_pair_iou": f"""WITH {_MP}, ms AS (SELECT obj_id AS frame, vec_id, string_agg(CASE WHEN m THEN '1' ELSE '0' END, '' ORDER BY k)::BIT AS bits FROM mp GROUP BY obj_id, vec_id)
SELECT a.frame, a.vec_id AS a, b.vec_id AS b, round(bit_count(a.bits & b.bits) / bit_count(a.bits | b.bits), 6) AS iou FROM ms a JOIN ms b ON a.frame = b.frame AND a.vec_id < b.vec_id AND bit_count(a.bits & b.bits) / bit_count(a.bits | b.bits) > 0.4""",
    "quality_mask_filter": f"""WITH RECURSIVE {_MP}, ms AS (SELECT obj_id, frame, string_agg(CASE WHEN m THEN '1' ELSE '0' END, '' ORDER BY k)::BIT AS bits, count(*) FILTER (m) / 64 BETWEEN 0.4 AND 0.6 AS ok FROM mp GROUP BY obj_id, frame),
st AS (SELECT obj_id, frame, CASE WHEN ok THEN bits END AS last, ok AS keep FROM ms WHERE frame = 0
  UNION ALL SELECT m.obj_id, m.frame, CASE WHEN j.ok THEN m.bits ELSE s.last END, j.ok FROM st s JOIN ms m ON m.obj_id = s.obj_id AND m.frame = s.frame + 1, LATERAL (SELECT m.ok AND (s.last IS NULL OR bit_count(s.last & m.bits) / bit_count(s.last | m.bits) >= 0.3) AS ok) j)
SELECT obj_id, frame FROM st WHERE keep""",
}
