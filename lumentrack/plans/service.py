"""Upload, job, label, scene, overlay and token queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrack.operators import fusion as fu
from lumentrack.operators import semantic as ml
from lumentrack.operators import service as sv
from lumentrack.operators import trajectory as tj
from lumentrack.plans.trajectory import SUMMARY_CTE
from lumentrack.sources.adapters import SQL, r6, rasters, tracks
from lumentrack.sources.tables import table


def upload_gate(spark, d):
    """Pages as uploads of at most 2,000 bytes; every seventh has another type."""
    p = table(spark, d, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), F.when(F.col("page_id") % 7 == 0, "text/html").otherwise("video/mp4").alias("type"))
    return p.select("page_id", sv.gate(F.col("size"), F.col("type"), 2000).alias("status"))


def label_map(spark, d):
    return sv.label_map(tracks(table(spark, d, "events")).select("obj_id", F.col("pos").alias("ord"), "label"))


def token_confidence(spark, d):
    """Embeddings as logits of tokens, ten times as sharp."""
    r = rasters(table(spark, d, "embeddings")).select(F.col("frame").alias("text_id"), F.transform("logits", lambda v: v * 10).alias("logits"))
    return sv.token_confidence(r, r.select("text_id").distinct()).withColumn("confidence", r6(F.col("confidence")))


def job_status(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("finished_at"))
    return sv.job_status(jobs, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id")), "F")


def job_outcomes(spark, d):
    """A job a user: its file, its track and the answers about it are judged; the first stage that fails ends the job, the others go on.

    Planted by user number: files that are missing or have no frames, times that go back, and answers that are cut short.
    """
    e = table(spark, d, "events")
    p = tracks(e)
    kind = F.col("job_id") % 13
    jobs = p.groupBy(F.col("obj_id").alias("job_id")).agg(F.count("*").alias("n")).select("job_id", F.when(kind != 1, F.col("n")).otherwise(0).alias("total_frames"), F.when(kind != 0, F.col("n") * 1000).alias("size_bytes"))
    source = fu.checked(jobs)[1].select("job_id", "error")
    track = tj.validity(p.withColumn("t", F.when((F.col("obj_id") % 13).isin(1, 2) & (F.col("pos") == 3), 0.0).otherwise(F.col("t")))).where("NOT valid").select(F.col("obj_id").alias("job_id"), F.col("message").alias("error"))
    texts = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.when(kind.isin(0, 3) & (F.col("event_id") % 2 == 0), F.substring("props", 1, 4)).otherwise(F.col("props")).alias("text")).withColumn("confidence", F.lit(1.0))
    answers = texts.select("id", "job_id").join(ml.parsed(texts), "id").groupBy("job_id").agg(F.count_if(~F.col("parse_success")).alias("bad"), F.count("*").alias("n_answers"))
    semantics = answers.where("bad > 0").select("job_id", F.format_string("%d answers can't be parsed", "bad").alias("error"))
    results = tj.summary(tj.smooth(p)).select(F.col("obj_id").alias("job_id"), "motion_type", "n_points").join(answers.select("job_id", "n_answers"), "job_id")
    return sv.process(jobs, [("source", source), ("tracking", track), ("semantics", semantics)], results)


def scene_rollup(spark, d):
    """Ten videos of the tracks' objects by the last digit of their ids; a track that goes further than 10 translates unless it is erratic."""
    s = tj.summary(tj.smooth(tracks(table(spark, d, "events"))))
    kind = F.when((F.col("displacement") > 10) & (F.col("motion_type") != "erratic"), "translating").otherwise(F.col("motion_type"))
    return sv.scene(s.select((F.col("obj_id") % 10).alias("video"), F.col("obj_id").alias("ord"), kind.alias("behaviour"), F.col("n_points").alias("n_frames")), "video").withColumn("complexity", r6(F.col("complexity")))


def overlay(spark, d):
    return sv.overlay(tracks(table(spark, d, "events")))


QUERIES = {f.__name__: f for f in (job_outcomes, upload_gate, label_map, token_confidence, job_status, scene_rollup, overlay)}

ORACLE_SQL = {
    "job_outcomes": f"""WITH {SUMMARY_CTE}, jb AS (SELECT obj_id AS job_id, obj_id % 13 AS kind, count(*) AS n FROM tr GROUP BY obj_id),
ba AS (SELECT obj_id AS job_id, bool_or(t2 < lag_t) AS bad FROM (SELECT obj_id, t2, lag(t2) OVER (PARTITION BY obj_id ORDER BY pos) AS lag_t FROM (SELECT obj_id, pos, CASE WHEN obj_id % 13 IN (1, 2) AND pos = 3 THEN 0.0 ELSE t END AS t2 FROM tr) q) r GROUP BY obj_id),
an AS (SELECT user_id AS job_id, count(*) AS n_answers, count(*) FILTER (try_cast(nullif(regexp_extract(text, '(?s)(\\{{.*\\}})', 1), '') AS JSON) IS NULL) AS cut FROM (SELECT user_id, CASE WHEN user_id % 13 IN (0, 3) AND event_id % 2 = 0 THEN substr(props, 1, 4) ELSE props END AS text FROM events) q GROUP BY user_id),
fe AS (SELECT jb.job_id, CASE WHEN kind < 2 THEN 'source' WHEN bad THEN 'tracking' WHEN cut > 0 THEN 'semantics' END AS stage, CASE WHEN kind = 0 THEN 'video not found' WHEN kind = 1 THEN 'video has no frames' WHEN bad THEN 'time goes back' WHEN cut > 0 THEN cut || ' answers can''t be parsed' END AS error, n_answers FROM jb JOIN ba USING (job_id) JOIN an USING (job_id))
SELECT job_id, CASE WHEN stage IS NULL THEN 'success' ELSE 'error' END AS status, stage, error, CASE WHEN stage IS NULL THEN motion_type END AS motion_type, CASE WHEN stage IS NULL THEN n_points END AS n_points, CASE WHEN stage IS NULL THEN n_answers END AS n_answers FROM fe JOIN su ON su.obj_id = fe.job_id""",
    "upload_gate": "SELECT page_id, (CASE WHEN page_id % 7 = 0 THEN 400 WHEN strlen(coalesce(html, '')) <= 2000 THEN 200 ELSE 413 END)::INTEGER AS status FROM pages",
    "label_map": f"WITH {SQL['tr']} SELECT obj_id, arg_max(label, pos) AS label FROM tr GROUP BY obj_id",
    "token_confidence": """WITH t AS (SELECT label AS text_id, list_transform(embedding, lambda v: v::DOUBLE * 10) AS l FROM embeddings), c AS (SELECT text_id, 1 / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) AS c FROM t)
SELECT text_id, round(coalesce(any_value(m), 0.5), 6) AS confidence FROM (SELECT DISTINCT text_id FROM t) LEFT JOIN (SELECT text_id, avg(c) AS m FROM c GROUP BY text_id) USING (text_id) GROUP BY text_id""",
    "job_status": """SELECT o_orderkey AS job_id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN coalesce(n, 0) END AS total_objects, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS finished_at, (CASE WHEN o_orderstatus = 'F' THEN 200 ELSE 400 END)::INTEGER AS download
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "scene_rollup": f"""WITH {SUMMARY_CTE}, k AS (SELECT obj_id, n_points, CASE WHEN displacement > 10 AND motion_type <> 'erratic' THEN 'translating' ELSE motion_type END AS b FROM su)
SELECT obj_id % 10 AS video, count(*) AS n_objects, arg_min(b, obj_id) <> 'stationary' AS dynamic, CASE WHEN bool_or(b = 'translating') THEN 'translational' ELSE 'static' END AS motion, round(count(*) * max(n_points) / 100, 6) AS complexity FROM k GROUP BY 1""",
    "overlay": f"WITH {SQL['tr']} SELECT pos AS frame_pos, obj_id, trunc(x)::BIGINT AS px, trunc(y)::BIGINT AS py FROM tr WHERE x IS NOT NULL AND y IS NOT NULL",
}
