"""Uploads, job documents, label maps, scene roll-ups, overlays and token confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(size: Column, content_type: Column, most: int) -> Column:
    """HTTP status of an upload: 400 unless its type is a video's, 413 beyond ``most`` bytes, else 200; a null type or size is refused."""
    return F.when(~F.coalesce(F.startswith(content_type, F.lit("video/")), F.lit(False)), 400).when(F.coalesce(size <= most, F.lit(False)), 200).otherwise(413)


def label_map(objects: DataFrame) -> DataFrame:
    """(obj_id, ord, label) -> obj_id, label: an object's last label."""
    return objects.groupBy("obj_id").agg(F.max_by("label", "ord").alias("label"))


def logit_confidence(logits: Column) -> Column:
    """The largest softmax probability of a token's logits; null for none."""
    top = F.array_max(logits)
    return F.when(F.size(logits) > 0, 1 / F.aggregate(logits, F.lit(0.0), lambda total, v: total + F.exp(v - top)))


def token_confidence(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, logits array<double>) a token -> text_id, confidence: the mean over a text's tokens, 0.5 where it has none."""
    means = tokens.groupBy("text_id").agg(F.avg(logit_confidence(F.col("logits"))).alias("c"))
    return texts.select("text_id").join(means, "text_id", "left").select("text_id", F.coalesce("c", F.lit(0.5)).alias("confidence"))


def job_status(jobs: DataFrame, objects: DataFrame, done: str) -> DataFrame:
    """(job_id, status, finished_at), (job_id, object) -> status and, for jobs that are ``done``, the number of objects and the time; the rest have nulls."""
    counts = objects.groupBy("job_id").agg(F.count("*").alias("n"))
    ended = F.col("status") == done
    return jobs.join(counts, "job_id", "left").select("job_id", "status", F.when(ended, F.coalesce("n", F.lit(0))).alias("total_objects"), F.when(ended, F.col("finished_at")).alias("finished_at"), F.when(ended, 200).otherwise(400).alias("download"))


def scene(objects: DataFrame, key: str) -> DataFrame:
    """(key, ord, behaviour, n_frames) -> a video's scene: dynamic if its first object moves, translational if any translates, complexity of objects times frames in hundreds."""
    return objects.groupBy(key).agg(
        F.count("*").alias("n_objects"), (F.min_by("behaviour", "ord") != "stationary").alias("dynamic"),
        F.when(F.bool_or(F.col("behaviour") == "translating"), "translational").otherwise("static").alias("motion"), (F.count("*") * F.max("n_frames") / 100).alias("complexity"),
    )


def overlay(points: DataFrame) -> DataFrame:
    """(obj_id, pos, x, y) -> frame_pos, obj_id, px, py: the whole pixels at which a track's point is drawn on the frame of its position."""
    return points.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("pos").alias("frame_pos"), "obj_id", F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"))


def first_errors(failures: list[tuple[str, DataFrame]]) -> DataFrame:
    """job_id, status, stage, error of each job that fails: the first of its failing stages, in the order given, and there the least message.

    A stage's failures are rows (job_id, error); null errors and null ids count for none. Stages are judged side by side and meet in one
    aggregation, so no stage waits for another; a failed job has one row, however many rows of it fail.
    """
    every = None
    for rank, (stage, rows) in enumerate(failures):
        own = rows.where("job_id IS NOT NULL AND error IS NOT NULL").select("job_id", F.struct(F.lit(rank).alias("rank"), F.lit(stage).alias("stage"), F.col("error").cast("string").alias("error")).alias("f"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("job_id").agg(F.min("f").alias("f")).select("job_id", F.lit("error").alias("status"), "f.stage", "f.error")


def process(jobs: DataFrame, failures: list[tuple[str, DataFrame]], results: DataFrame) -> DataFrame:
    """A row each of ``jobs`` (job_id): its result columns with status success, or status error with its first failing stage and error; other jobs go on.

    ``results`` has a row a job at most. A job that neither fails nor has a result succeeds with null columns; results of failed jobs, which later stages may have
    made in part, are left out.
    """
    wrong = first_errors(failures).withColumnRenamed("status", "_status")
    own = [c for c in results.columns if c != "job_id"]
    j = jobs.select("job_id").join(wrong, "job_id", "left").join(results, "job_id", "left")
    return j.select("job_id", F.coalesce("_status", F.lit("success")).alias("status"), "stage", "error", *[F.when(F.col("_status").isNull(), F.col(c)).alias(c) for c in own])
