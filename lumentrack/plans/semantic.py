"""Sampling, semantic, fusion and job queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumentrack.operators import sampling as fr
from lumentrack.operators import semantic as ml
from lumentrack.operators import trajectory as tj
from lumentrack.plans.trajectory import SUMMARY_CTE
from lumentrack.sources.adapters import SQL, r6, tracks
from lumentrack.sources.tables import table


def _scores(spark, d):
    """Every fifth event of a user is an analysed frame, its value the motion score."""
    p = tracks(table(spark, d, "events")).select(F.col("obj_id").alias("video"), F.col("pos").alias("frame"), (F.col("x") / 5).alias("score"))
    return p, p.groupBy("video").agg((F.max("frame") + 1).alias("total"))


def uniform_sample(spark, d):
    totals = _scores(spark, d)[1]
    return totals.select("video", F.posexplode(fr.uniform(F.col("total").cast("int"), 16)).alias("i", "frame"))


def motion_scores(spark, d):
    p, totals = _scores(spark, d)
    out = fr.fill_scores(p.where("frame % 5 = 0"), totals)
    return out.select("video", "frame", r6(F.col("score")).alias("score"), fr.motion_class(r6(F.col("score"))).alias("class"))


def motion_segments(spark, d):
    return fr.segments(_scores(spark, d)[0]).withColumn("intensity", r6(F.col("intensity")))


def _bins(spark, d):
    """Histograms of every tenth frame: the labels' numbers of ten events of a user, in eight-fold steps of 32."""
    p = tracks(table(spark, d, "events"))
    return p.groupBy(F.col("obj_id").alias("video"), (F.floor(F.col("pos") / 10) * 10).alias("frame"), F.floor(F.col("y") / 32).alias("bin")).agg(F.count("*").alias("n"))


def adaptive_frames(spark, d):
    p, totals = _scores(spark, d)
    return fr.allocate(fr.segments(p), fr.scene_changes(_bins(spark, d), totals), totals, 28, 16)


def scene_changes(spark, d):
    return fr.scene_changes(_bins(spark, d), _scores(spark, d)[1])


def extracted_frames(spark, d):
    return fr.extract(_scores(spark, d)[1])


def sampling_metadata(spark, d):
    """How each user's frames were sampled; every user's video counts a second time, numbered -1 and down, as one whose analysis failed, so all of them fall back too."""
    p, totals = _scores(spark, d)
    failed = totals.withColumn("video", -1 - F.col("video"))
    out = fr.sample(p, _bins(spark, d), totals.unionByName(failed), 28, 16)[1]
    return out.withColumn("avg_motion_intensity", r6(F.col("avg_motion_intensity")))


def prompt_grid(spark, d):
    """Each part is a video of its own size; every fourth is prompted at its centre alone, the others by grids of one to three points a side."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("video"), (F.col("p_size") * 16 + 3).alias("width"), (F.col("p_size") * 9 + 1).alias("height"), (F.col("p_partkey") % 4).cast("int").alias("n"))
    return fr.prompt_grid(p).withColumns({c: r6(F.col(c)) for c in "xy"})


def label_match(spark, d):
    e = tracks(table(spark, d, "events"))
    pairs = e.select("obj_id", F.col("pos").alias("ord"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("object_"), F.col("pos"))).otherwise(F.col("label")).alias("label"), (F.col("y") / 100).alias("iou"))
    return ml.best_match(pairs, e.select("obj_id").distinct()).withColumn("confidence", r6(F.col("confidence")))


def label_consensus(spark, d):
    return ml.consensus(tracks(table(spark, d, "events")).select("obj_id", "pos", "label"))


def label_refine(spark, d):
    spark_rows = [("action", "click"), ("action", "VIEW"), ("money", "purchase")]
    votes = ml.consensus(tracks(table(spark, d, "events")).select("obj_id", "pos", "label")).withColumn("confidence", F.col("n") / F.col("votes"))
    return ml.refine(votes.select("obj_id", "label", "confidence"), spark.createDataFrame(spark_rows, "parent string, child string")).withColumn("confidence", r6(F.col("confidence")))


def text_confidence(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, d, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("text")))
    return t.select("id", r6(ml.text_confidence(F.col("text"))).alias("confidence"))


def semantic_parse(spark, d):
    """Texts with JSON, with broken JSON and with none."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("say "), "props", F.lit(" end"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("say {"), "event_type", F.lit("} end"))).otherwise(F.col("event_type")).alias("text"))
    return ml.parsed(e.withColumn("confidence", ml.text_confidence(F.col("text")))).withColumn("confidence", r6(F.col("confidence")))


#: Answers of every shape, by event number: keys in and out of order, present keys without lists, lists as a whole, aliases that are empty, broken JSON. %1 is the type, %2 the number.
SHAPES = (
    'say {"objects": [{"label": "%1", "box": [%2]}, 3, {"class": "", "confidence": 0.5}]} end', '{"detections": [{"class": "%1", "bbox": [], "bounding_box": {"x": %2}}, {"label": 0, "object_id": "o%2"}]}',
    '{"objects": "none", "trajectories": [{"label": "%1"}]}', '[{"label": "%1", "confidence": null}, [], {"object_id": false, "class": "c%2"}]', '{"trajectories": [], "detections": [{"label": "%1"}]}',
    'say {"trajectories": [3, {"object_id": "%1", "action": "moves"}], "objects": [{"label": "x"}]}', '{"trajectories": [], "objects": [{"label": "%1", "behavior": "rolls"}]}', '{"objects": [{"label": "%1"}', 'nothing of %1 is to be seen', '{"trajectories": [3], "objects": [{"label": "%1", "action": ""}]}',
    '{"objects": null, "detections": [{"label": "%1"}]}',
)


def _answers(spark, d):
    e = table(spark, d, "events")
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("obj_id"), F.replace(F.replace(shape, F.lit("%1"), F.col("event_type")), F.lit("%2"), F.col("event_id").cast("string")).alias("text"))


def json_objects(spark, d):
    """Objects of an answer an event, of all shapes."""
    return ml.json_objects(_answers(spark, d))


def fallback_labels(spark, d):
    """Names of an event's user by the event's answer."""
    a = _answers(spark, d)
    return ml.fallback_label(a.select("id", "text"), a.select("id", "obj_id"))


def cross_modal_confidence(spark, d):
    e = tracks(table(spark, d, "events")).groupBy("obj_id").agg(F.avg(F.col("y") / 100).alias("s"), F.avg(F.col("z") / 24).alias("dd"), F.max(F.col("y") / 100).alias("c"), F.min(F.col("z") / 24).alias("k"))
    return e.select("obj_id", r6(ml.cross_modal(F.col("s"), F.col("dd"), F.when(F.col("obj_id") % 9 != 0, F.col("c")), F.col("k"))).alias("confidence"), r6(ml.overall_consistency(F.col("s"), F.col("dd") / 4, F.col("c"))).alias("consistency"))


def fused_tracks(spark, d):
    """Objects of all tracks: smoothed motion, label by consensus, tracking confidence and cross-modal confidence, a row an object."""
    e = tracks(table(spark, d, "events"))
    s = tj.summary(tj.smooth(e))
    votes = ml.consensus(e.select("obj_id", "pos", "label"))
    agg = e.groupBy("obj_id").agg(F.avg(F.col("y") / 100).alias("s"), F.avg(F.col("z") / 24).alias("dd"))
    j = s.join(votes, "obj_id").join(agg, "obj_id").join(tj.temporal_consistency(e.withColumn("score", F.col("y") / 100), "score"), "obj_id")
    return j.select(
        F.concat(F.lit("track_"), F.col("obj_id")).alias("object_id"), "label", "motion_type", "n_points", F.when(F.col("n_points") > 10, "high").otherwise("medium").alias("tracking_confidence"),
        r6(F.col("displacement")).alias("displacement"), r6(F.col("mean_speed") * 1000).alias("mean_speed_scaled"), r6(ml.cross_modal(F.col("s"), F.col("dd"), F.col("n") / F.col("votes"), F.col("temporal_consistency"))).alias("confidence"), r6(F.col("temporal_consistency")).alias("temporal_consistency"),
    )


def jobs_page(spark, d):
    """The page of jobs after the first twenty, newest first, ten a page, with the number of all jobs."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    page = o.orderBy(F.desc("created_at"), "job_id").offset(20).limit(10)
    return page.crossJoin(o.agg(F.count("*").alias("total"))).select("job_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), "status", "total")  # one row of totals


def job_states(spark, d):
    """Last state of each job; cancelling counts unless a job has already ended."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", "event_type")
    ended = F.coalesce(F.max((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = e.withColumn("ended", ended).where("ended = 0")
    return live.groupBy("job_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


def rate_limit(spark, d):
    """Requests of each key with their verdict: at most three accepted in any thirty hours; only accepted ones count."""
    from lumentrack.operators.requests import accepted

    return accepted(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), 108000.0, 3)


QUERIES = {f.__name__: f for f in (uniform_sample, motion_scores, motion_segments, adaptive_frames, scene_changes, extracted_frames, sampling_metadata, prompt_grid, label_match, label_consensus, label_refine, text_confidence, semantic_parse, json_objects, fallback_labels, cross_modal_confidence, fused_tracks, jobs_page, job_states, rate_limit)}

_SC = f"{SQL['tr']}, sc AS (SELECT obj_id AS video, pos AS frame, x / 5 AS score FROM tr), tt AS (SELECT video, max(frame) + 1 AS total FROM sc GROUP BY video)"
_CLS = "CASE WHEN score < 1 THEN 'static' WHEN score < 5 THEN 'low' WHEN score < 15 THEN 'medium' ELSE 'high' END"
_SEG = f"""{_SC}, c0 AS (SELECT video, frame, score, {_CLS} AS class FROM sc JOIN tt USING (video) WHERE frame < total - 1), c1 AS (SELECT *, CASE WHEN class <> lag(class) OVER (PARTITION BY video ORDER BY frame) THEN 1 ELSE 0 END AS f FROM c0),
c2 AS (SELECT *, sum(f) OVER (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM c1), sgm AS (SELECT video, min(frame) AS "start", max(frame) + 1 AS "end", any_value(class) AS class, avg(score) AS intensity FROM c2 GROUP BY video, island)"""
_VOTE = f"{SQL['tr']}, v AS (SELECT obj_id, label, count(*) AS n, min(pos) AS f FROM tr GROUP BY obj_id, label), vt AS (SELECT obj_id, CASE WHEN sum(n) OVER (PARTITION BY obj_id) >= 3 THEN label ELSE first_value(label) OVER (PARTITION BY obj_id ORDER BY f) END AS label, n, (sum(n) OVER (PARTITION BY obj_id))::BIGINT AS votes, row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, label) AS r FROM v)"
_HEUR = """0.7::DOUBLE * CASE WHEN length(text) < 50 THEN 0.5::DOUBLE WHEN length(text) > 2000 THEN 0.8 ELSE 1.0 END * CASE WHEN text LIKE '%{%' AND text LIKE '%}%' THEN 1.1::DOUBLE ELSE 0.5 END
  * power(0.6::DOUBLE, (text ILIKE '%error%')::INTEGER + (text ILIKE '%failed%')::INTEGER + (text ILIKE '%unable%')::INTEGER + (text ILIKE '%cannot%')::INTEGER + (text ILIKE '%sorry%')::INTEGER + (text ILIKE '%don''t know%')::INTEGER)
  * (1 + 0.05::DOUBLE * ((text ILIKE '%object%')::INTEGER + (text ILIKE '%trajectory%')::INTEGER + (text ILIKE '%position%')::INTEGER + (text ILIKE '%movement%')::INTEGER + (text ILIKE '%detected%')::INTEGER))"""
_BIN = """b AS (SELECT obj_id AS video, pos // 10 * 10 AS frame, floor(y / 32)::BIGINT AS bin, count(*) AS n FROM tr GROUP BY 1, 2, 3), h AS (SELECT video, frame, bin, n / sqrt(sum(n * n) OVER (PARTITION BY video, frame)) AS v FROM b),
x AS (SELECT a.video, a.frame + 10 AS frame, sum(power(a.v - coalesce(c.v, 0), 2) / a.v) AS distance FROM h a LEFT JOIN h c ON c.video = a.video AND c.frame = a.frame + 10 AND c.bin = a.bin WHERE EXISTS (SELECT 1 FROM b WHERE b.video = a.video AND b.frame = a.frame + 10) GROUP BY 1, 2),
sn AS (SELECT video, frame FROM x WHERE distance > 0.3 UNION SELECT video, 0 FROM tt UNION SELECT video, total - 1 FROM tt)"""
_ALLOC = f"""{_BIN}, u AS (SELECT video, unnest(generate_series("start", "end" - 1, CASE class WHEN 'high' THEN 2 WHEN 'medium' THEN 5 WHEN 'low' THEN 10 ELSE 20 END)) AS frame FROM sgm UNION SELECT video, "end" - 1 FROM sgm UNION SELECT video, frame FROM sn),
k AS (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS r, count(*) OVER (PARTITION BY video) AS n FROM u), p AS (SELECT video, frame FROM k WHERE n <= 28 OR r IN (SELECT floor(i * n / 28) FROM range(28) q(i))),
s AS (SELECT tt.video, total FROM tt LEFT JOIN (SELECT video, count(*) AS c FROM p GROUP BY video) y ON y.video = tt.video WHERE coalesce(c, 0) < 16),
fr AS (SELECT video, frame::INTEGER AS frame FROM p UNION SELECT video, (CASE WHEN i = 15 THEN total - 1 ELSE floor(i * ((total - 1) / 15)) END)::INTEGER FROM s, range(16) q(i))"""
_FUSED = f"""WITH {SUMMARY_CTE}, {_VOTE.removeprefix(SQL["tr"] + ", ")}, fg AS (SELECT obj_id, avg(y / 100) AS s, avg(z / 24) AS d FROM tr GROUP BY obj_id), m AS (SELECT obj_id, CASE WHEN pos >= 4 THEN avg(y / 100) OVER (PARTITION BY obj_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS m FROM tr),
tc AS (SELECT obj_id, coalesce(1 - least(1.0, 2 * var_pop(m)), 1.0) AS tc FROM m GROUP BY obj_id)
SELECT 'track_' || su.obj_id AS object_id, vt.label, motion_type, n_points, CASE WHEN n_points > 10 THEN 'high' ELSE 'medium' END AS tracking_confidence, round(displacement, 6) AS displacement, round(mean_speed * 1000, 6) AS mean_speed_scaled,
round(CASE WHEN s <> 0 AND d IS NOT NULL THEN least(1.0, power(s, 0.4) * power(d, 0.3) * power(n / votes, 0.3) * (0.5 + 0.5 * tc)) ELSE 0.7 END, 6) AS confidence, round(tc, 6) AS temporal_consistency FROM su JOIN vt ON vt.obj_id = su.obj_id AND r = 1 JOIN fg ON fg.obj_id = su.obj_id JOIN tc ON tc.obj_id = su.obj_id"""

_QUOTED = "CASE event_id % " + str(len(SHAPES)) + " " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(SHAPES)) + " END"
_TRUE = lambda j: f"({j} IS NOT NULL AND {j}::VARCHAR NOT IN ('null', 'false', '0', '0.0', '\"\"', '[]', '{{}}'))"
_PICK = lambda o, keys: "coalesce(" + ", ".join(f"CASE WHEN {_TRUE(f'json_extract({o}, chr(36) || chr(46) || chr(34) || {k!r} || chr(34))')} THEN json_extract_string({o}, chr(36) || chr(46) || chr(34) || {k!r} || chr(34)) END" for k in keys) + ")"
_ANSWERS = f"""an AS (SELECT event_id AS id, user_id AS obj_id, replace(replace({_QUOTED}, '%1', event_type), '%2', event_id::VARCHAR) AS text FROM events),
js AS (SELECT id, obj_id, CASE WHEN text LIKE '[%' THEN try_cast(text AS JSON) ELSE try_cast(nullif(regexp_extract(text, '(?s)(\\{{.*\\}})', 1), '') AS JSON) END AS v FROM an)"""

ORACLE_SQL = {
    "uniform_sample": f"WITH {_SC} SELECT video, i::INTEGER AS i, (CASE WHEN i = 15 THEN total - 1 ELSE floor(i * ((total - 1) / 15)) END)::INTEGER AS frame FROM tt, range(16) r(i)",
    "motion_scores": f"""WITH {_SC}, a AS (SELECT video, frame, score, lead(frame) OVER (PARTITION BY video ORDER BY frame) AS nf, lead(score) OVER (PARTITION BY video ORDER BY frame) AS ns FROM sc WHERE frame % 5 = 0),
o AS (SELECT a.video, s.frame, round(CASE WHEN nf IS NULL OR s.frame = a.frame THEN a.score ELSE a.score + (s.frame - a.frame) / (nf - a.frame) * (ns - a.score) END, 6) + 0.0 AS score FROM sc s JOIN a ON a.video = s.video AND a.frame = s.frame - s.frame % 5) SELECT video, frame, score, {_CLS} AS class FROM o""",
    "motion_segments": f'WITH {_SEG} SELECT video, "start", "end", class, round(intensity, 6) + 0.0 AS intensity FROM sgm',
    "adaptive_frames": f"WITH {_SEG}, {_ALLOC} SELECT video, frame FROM fr",
    "scene_changes": f"WITH {_SC}, {_BIN} SELECT video, frame::BIGINT AS frame FROM sn",
    "extracted_frames": f"WITH {_SC}, n AS (SELECT video, total, least(32, total) AS n FROM tt) SELECT video, i::INTEGER AS i, (CASE WHEN i = n - 1 AND n > 1 THEN total - 1 ELSE floor(i * ((total - 1) / greatest(1, n - 1))) END)::INTEGER AS frame FROM n, range(32) r(i) WHERE i < n",
    "sampling_metadata": f"""WITH {_SEG}, {_ALLOC}, c AS (SELECT video, count(*) AS sampled_frames FROM (SELECT DISTINCT video, frame FROM fr) q GROUP BY video)
SELECT tt.video, total AS total_frames, sampled_frames, (SELECT count(*) FROM sgm WHERE sgm.video = tt.video) AS motion_segments, (SELECT count(*) FROM sn WHERE sn.video = tt.video) AS scene_changes,
(SELECT round(avg(score), 6) FROM sc WHERE sc.video = tt.video) AS avg_motion_intensity, 'adaptive_motion_based' AS sampling_strategy FROM tt JOIN c USING (video)
UNION ALL SELECT -1 - video, any_value(total), count(DISTINCT CASE WHEN i = 27 THEN total - 1 ELSE floor(i * ((total - 1) / 27)) END), NULL, NULL, NULL, 'uniform_fallback' FROM tt, range(28) q(i) GROUP BY video""",
    "prompt_grid": """WITH p AS (SELECT p_partkey AS video, p_size * 16 + 3 AS w, p_size * 9 + 1 AS h, p_partkey % 4 AS n FROM part)
SELECT video, 1::INTEGER AS obj_id, (w // 2)::DOUBLE AS x, (h // 2)::DOUBLE AS y FROM p WHERE n = 0
UNION ALL SELECT video, (i * n + j + 1)::INTEGER, round(0.1::DOUBLE * w + i * (0.8::DOUBLE * w / greatest(1, n - 1)), 6), round(0.1::DOUBLE * h + j * (0.8::DOUBLE * h / greatest(1, n - 1)), 6) FROM p, range(3) a(i), range(3) b(j) WHERE i < n AND j < n""",
    "label_match": f"""WITH {SQL['tr']}, p AS (SELECT obj_id, pos, CASE WHEN pos % 3 = 0 THEN 'object_' || pos ELSE label END AS label, y / 100 AS iou FROM tr), c AS (SELECT *, least(1.0, iou * CASE WHEN label LIKE 'object\\_%' ESCAPE '\\' THEN 1.0::DOUBLE ELSE 1.2 END) AS c FROM p WHERE iou >= 0.3),
m AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY c DESC, pos) AS r FROM c)
SELECT o.obj_id, coalesce(m.label, 'object_' || o.obj_id) AS label, round(coalesce(c, 0.5), 6) AS confidence, CASE WHEN m.obj_id IS NULL THEN 'fallback' ELSE 'spatial' END AS method FROM (SELECT DISTINCT obj_id FROM tr) o LEFT JOIN m ON m.obj_id = o.obj_id AND m.r = 1""",
    "label_consensus": f"WITH {_VOTE} SELECT obj_id, label, n, votes FROM vt WHERE r = 1",
    "label_refine": f"WITH {_VOTE} SELECT obj_id, label, CASE lower(label) WHEN 'click' THEN 'action' WHEN 'view' THEN 'action' WHEN 'purchase' THEN 'money' ELSE label END AS parent, round(n / votes * CASE WHEN lower(label) IN ('click', 'view', 'purchase') THEN 1.1::DOUBLE ELSE 1.0 END, 6) AS confidence FROM vt WHERE r = 1",
    "text_confidence": f"WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - page_id, coalesce(html, '') FROM pages) SELECT id, round(least(1.0, {_HEUR}), 6) AS confidence FROM t",
    "semantic_parse": f"WITH t AS (SELECT event_id AS id, event_id % 3 AS m, CASE event_id % 3 WHEN 0 THEN 'say ' || props || ' end' WHEN 1 THEN 'say {{' || event_type || '}} end' ELSE event_type END AS text FROM events) SELECT id, m = 0 AS parse_success, round(least(1.0, {_HEUR}) * CASE m WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.3 ELSE 0.2 END, 6) AS confidence FROM t",
    "json_objects": f"""WITH {_ANSWERS}, ls AS (SELECT id, coalesce(json_extract(v, '$.objects'), json_extract(v, '$.trajectories'), json_extract(v, '$.detections'), CASE WHEN json_type(v) = 'ARRAY' THEN v END) AS held FROM js),
el AS (SELECT id, i::INTEGER AS ord, json_extract(held, '$[' || i || ']') AS o FROM ls, range(3) r(i) WHERE json_type(held) = 'ARRAY' AND i < json_array_length(held))
SELECT id, ord, coalesce({_PICK('o', ml.LABEL_KEYS)}, 'unknown') AS label, {_PICK('o', ml.BOX_KEYS)} AS bbox, CASE WHEN json_extract(o, '$.confidence') IS NULL THEN 1.0 ELSE try_cast(json_extract_string(o, '$.confidence') AS DOUBLE) END AS confidence FROM el WHERE json_type(o) = 'OBJECT'""",
    "fallback_labels": f"""WITH {_ANSWERS}, ls AS (SELECT id, obj_id, CASE WHEN {_TRUE("json_extract(v, '$.trajectories')")} THEN json_extract(v, '$.trajectories') ELSE json_extract(v, '$.objects') END AS held FROM js),
el AS (SELECT id, i, json_extract(held, '$[' || i || ']') AS o FROM ls, range(3) r(i) WHERE json_type(held) = 'ARRAY' AND i < json_array_length(held)),
fi AS (SELECT id, arg_min(o, i) AS o FROM el WHERE json_type(o) = 'OBJECT' GROUP BY id)
SELECT ls.id, obj_id, coalesce({_PICK('o', ('object_id', 'label'))}, 'object_' || obj_id) AS label, coalesce({_PICK('o', ('action', 'behavior'))}, 'stationary') AS behaviour FROM ls LEFT JOIN fi ON fi.id = ls.id""",
    "cross_modal_confidence": f"""WITH {SQL['tr']}, g AS (SELECT obj_id, avg(y / 100) AS s, avg(z / 24) AS d, max(y / 100) AS c, min(z / 24) AS k FROM tr GROUP BY obj_id)
SELECT obj_id, round(CASE WHEN s <> 0 AND obj_id % 9 <> 0 AND c <> 0 THEN least(1.0, power(s, 0.4) * power(d, 0.3) * power(c, 0.3) * (0.5 + 0.5 * k)) ELSE 0.7 END, 6) AS confidence, round(greatest(0.0, least(1.0, 0.4 * s + 0.3 * (1 - least(1.0, d / 4 / 0.2)) + 0.3 * c)), 6) AS consistency FROM g""",
    "jobs_page": "SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_orderstatus AS status, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20",
    "job_states": """WITH e AS (SELECT *, coalesce(max((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM events)
SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM e WHERE ended = 0 GROUP BY user_id""",
    "rate_limit": """WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, id, n, [sec] AS kept, true AS accepted FROM o WHERE n = 1 UNION ALL SELECT o.key, o.id, o.n, CASE WHEN len(k.kept) < 3 THEN list_append(k.kept, o.sec) ELSE k.kept END, len(k.kept) < 3 FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1, LATERAL (SELECT list_filter(r.kept, lambda t: t > o.sec - 108000) AS kept) k)
SELECT key, id, accepted FROM r""",
    "fused_tracks": _FUSED,
}
