"""Streaming forms of the stateful queries, drained into tables, and the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrack.operators import masks as mk
from lumentrack.plans import fusion, raster, semantic, trajectory
from lumentrack.sources.adapters import r6, rasters
from lumentrack.streaming import stateful
from lumentrack.streaming.tables import drain, read


def _points(spark, d):
    e = read(spark, f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("obj_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("ord"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.hour("ts").cast("double").alias("z"))


def stream_rate_limit(spark, d):
    """As rate_limit: at most three accepted requests of a key in any thirty hours."""
    e = read(spark, f"{d}/events.parquet")
    requests = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return drain(stateful.rate_limit(requests, 108000.0, 3), "rate-limit")


def stream_mask_filter(spark, d):
    """As temporal_mask_filter."""
    bits = F.aggregate(F.transform("logits", lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    masks = rasters(read(spark, f"{d}/embeddings.parquet")).select(F.col("frame").alias("obj_id"), F.col("mask_id").alias("ord"), bits.alias("bits"))
    return drain(stateful.temporal_filter(masks, 0.3), "mask-filter").withColumn("obj_id", F.col("obj_id").cast("int"))


def stream_quality_mask_filter(spark, d):
    """As quality_mask_filter, with masks as runs in the state: the ids of the masks that stay."""
    r = rasters(read(spark, f"{d}/embeddings.parquet")).select(F.col("frame").cast("long").alias("obj_id"), F.col("mask_id").alias("frame"), mk.runs(F.col("logits"), 8).alias("runs"))
    kept = stateful.mask_filter(r.withColumn("is_valid", (mk.area(F.col("runs")) / 64).between(0.4, 0.6)), 0.3)
    return drain(kept, "quality-mask-filter").select("obj_id", F.col("frame").alias("mask_id"))


def stream_clamp_speed(spark, d):
    """As track_clamp_speed."""
    return drain(stateful.clamp_speed(_points(spark, d), trajectory.MAX_SPEED), "clamp-speed").withColumns({c: r6(F.col(c)) for c in ("x", "y", "z", "measure")})


def stream_clamp_acceleration(spark, d):
    """As track_clamp_acceleration."""
    out = drain(stateful.clamp_acceleration(_points(spark, d), trajectory.MAX_ACCELERATION), "clamp-acceleration")
    return out.withColumn("measure", F.col("measure") * 1e3).withColumns({c: r6(F.col(c)) for c in ("x", "y", "z", "measure")})


def stream_job_states(spark, d):
    """As job_states: the last change of each job and their number."""
    e = read(spark, f"{d}/events.parquet")
    changes = drain(stateful.job_changes(e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.col("event_type").alias("state")), "purchase"), "job-states")
    return changes.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("n_events"))


QUERIES = {f.__name__: f for f in (stream_rate_limit, stream_mask_filter, stream_quality_mask_filter, stream_clamp_speed, stream_clamp_acceleration, stream_job_states)}
ORACLE_SQL = {
    stream: batch[name]
    for stream, batch, name in (
        ("stream_rate_limit", semantic.ORACLE_SQL, "rate_limit"), ("stream_mask_filter", raster.ORACLE_SQL, "temporal_mask_filter"), ("stream_clamp_speed", trajectory.ORACLE_SQL, "track_clamp_speed"),
        ("stream_clamp_acceleration", trajectory.ORACLE_SQL, "track_clamp_acceleration"), ("stream_job_states", semantic.ORACLE_SQL, "job_states"),
    )
}
ORACLE_SQL["stream_quality_mask_filter"] = f"SELECT q.obj_id, r.vec_id AS mask_id FROM ({fusion.ORACLE_SQL['quality_mask_filter']}) q JOIN (SELECT vec_id, label AS obj_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings) r ON r.obj_id = q.obj_id AND r.frame = q.frame"
