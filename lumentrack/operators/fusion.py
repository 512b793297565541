"""Fusion of masks, depth maps and semantic objects into one row an object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.operators import masks as mk
from lumentrack.operators import physics as ph
from lumentrack.operators import semantic as ml
from lumentrack.operators import trajectory as tj
from lumentrack.operators.raster import bilinear, clip01
from lumentrack.sources.store import stored

#: Limits of agreement (fixed values): spatial IoU, centroid distance as a share of the diagonal, depth variance, overall.
MIN_IOU, MAX_DISTANCE, MAX_VARIANCE, MIN_OVERALL = 0.3, 0.2, 2.0, 0.5


def box_centre(box: Column) -> tuple[Column, Column]:
    return box["x"] + box["w"] / 2, box["y"] + box["h"] / 2


def distance_share(a: tuple[Column, Column], b: tuple[Column, Column], width: int, height: int) -> Column:
    """Distance of two points as a share of the frame's diagonal."""
    return F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) / F.lit((width**2 + height**2) ** 0.5)


def variance(values: Column) -> Column:
    """Population variance of an array; null if it is empty."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / n
    spread = F.aggregate(values, F.struct(F.lit(0.0).alias("t"), mean.alias("m")), lambda s, v: F.struct((s["t"] + (v - s["m"]) * (v - s["m"])).alias("t"), s["m"].alias("m")), lambda s: s["t"])
    return F.when(n > 0, spread / n)


def consistency(rows: DataFrame, width: int, height: int) -> DataFrame:
    """(runs, depth, box, ...) -> the same with x, y (mask centroid), spatial_iou, centroid_distance, depth_consistency, overall_consistency, is_consistent.

    ``depth`` is a row-major array of the frame's size. Without a box the IoU is 1 and the distance 0.
    """
    r, box = F.col("runs"), F.col("box")
    x, y = mk.centroid(r)
    out = rows.withColumn("x", x).withColumn("y", y)
    out = out.withColumns({
        "spatial_iou": F.when(box.isNull(), 1.0).otherwise(mk.box_iou(r, box, width, height)),
        "centroid_distance": F.when(box.isNull(), 0.0).otherwise(distance_share((F.col("x"), F.col("y")), box_centre(box), width, height)),
        "spread": variance(mk.inside(r, F.col("depth"), width)),
    }).withColumn("depth_consistency", F.when(F.col("spread").isNull(), 0.0).otherwise(clip01(F.exp(-F.col("spread") / MAX_VARIANCE)))).drop("spread")
    out = out.withColumn("overall_consistency", ml.overall_consistency(F.col("spatial_iou"), F.col("centroid_distance"), F.col("depth_consistency")))
    agrees = (F.col("spatial_iou") >= MIN_IOU) & (F.col("centroid_distance") <= MAX_DISTANCE) & (F.col("overall_consistency") >= MIN_OVERALL)
    return out.withColumn("is_consistent", agrees)


def consistent(objects: DataFrame, column: str = "overall_consistency", least: float = 0.5) -> DataFrame:
    """Objects of at least this consistency; a missing one counts as 0."""
    return objects.where(F.coalesce(F.col(column), F.lit(0.0)) >= least)


def timestamp(frame: Column, fps: float, pos: Column) -> Column:
    """Seconds of a frame, to three decimals; at 30 frames a second by position where the rate is unknown."""
    return F.bround(frame / F.lit(float(fps)) if fps > 0 else pos / 30.0, 3)


def points(masks: DataFrame, depth: DataFrame, sampled: DataFrame, boxes: DataFrame, fps: float, width: int, height: int) -> DataFrame:
    """A row for each sampled frame in which an object has a mask and the frame has a depth map.

    masks (video, obj_id, frame, runs), depth (video, pos, depth), sampled (video, pos, frame),
    boxes (video, ord, label, box). An object's frames without a mask or a depth map are skipped, and empty masks. The box is
    a video's first semantic object that has one.
    """
    first = boxes.where("box IS NOT NULL").groupBy("video").agg(F.min_by("box", "ord").alias("box"))
    rows = sampled.join(masks, ["video", "frame"]).join(depth, ["video", "pos"]).join(first, "video", "left").where(F.size("runs") > 0)
    rows = consistency(rows, width, height)
    order = Window.partitionBy("obj_id").orderBy("at")
    return rows.withColumnRenamed("pos", "at").select(
        "video", "obj_id", (F.row_number().over(order) - 1).alias("pos"), "frame", timestamp(F.col("frame"), fps, F.col("at")).alias("t"), "x", "y",
        bilinear(F.col("depth"), F.col("x"), F.col("y"), width, height).alias("z"), (mk.area(F.col("runs")) / (width * height)).alias("coverage"), F.col("overall_consistency").alias("score"),
    )


def spatial_pairs(masks: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(obj_id, ord, label, iou) of every mask (video, obj_id, runs) with every box of its video; a video has few boxes, those of one model's answer."""
    met = masks.join(boxes.where("box IS NOT NULL").select("video", "ord", "label", "box"), "video")
    return met.select("obj_id", "ord", "label", mk.box_iou(F.col("runs"), F.col("box"), width, height).alias("iou"))


def quality_metrics(masks: DataFrame) -> DataFrame:
    """(obj_id, avg_confidence, tracking_frames) over all frames of ``masks``, sampled or not: the mean, 0 where no mask has a confidence, and how many have one."""
    return masks.groupBy("obj_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.count("confidence").alias("tracking_frames"))


def with_quality(objects: DataFrame, metrics: DataFrame) -> DataFrame:
    """``objects`` with their quality metrics by obj_id; 0 and 0 for one without."""
    return objects.join(metrics, "obj_id", "left").withColumns({"avg_confidence": F.coalesce("avg_confidence", F.lit(0.0)), "tracking_frames": F.coalesce("tracking_frames", F.lit(0))})


def fuse(masks: DataFrame, depth: DataFrame, sampled: DataFrame, boxes: DataFrame, fps: float, width: int, height: int, depth_confidence: float | None, semantic_confidence: float | None) -> DataFrame:
    """A row an object that has points: label, motion, extents, confidences and physics; inputs as for ``points``, masks with ``confidence``.

    Tracks are smoothed, their motion named, then clamped by the limits of an unknown class. The
    label is that of the box that best meets the object's first sampled mask. ``mask_confidence`` is the mean over sampled
    frames, 0.5 where no mask has one; ``avg_confidence`` and ``tracking_frames`` are those of ``quality_metrics``.
    The smoothed track is written once, and all that is told of it is read from there.
    """
    p = points(masks, depth, sampled, boxes, fps, width, height)
    smooth = stored(tj.smooth(p.select("obj_id", "pos", "t", *tj.AXES, "score")), "fused-tracks")
    motion = tj.summary(smooth).select("obj_id", "n_points", "duration", "mean_speed", "motion_type")
    table = ph.limits(p.sparkSession)
    unknown = table.where("class = 'unknown'").first()
    limited = ph.metres(smooth.select("obj_id", "pos", "t", *tj.AXES)).withColumns({"max_speed": F.lit(unknown.max_speed), "max_acceleration": F.lit(unknown.max_acceleration)})
    moved = ph.metres(ph.clamp(limited), 1 / ph.PIXEL_TO_METRE)
    ends = [F.max_by(c, "pos") - F.min_by(c, "pos") for c in tj.AXES]
    valid = moved.groupBy("obj_id").agg(
        *[f(c).alias(f"{k}_{c}") for c in tj.AXES for k, f in (("min", F.min), ("max", F.max))], F.sqrt(sum(F.pow(e, 2) for e in ends)).alias("displacement"),
        F.count_if("fast").alias("n_speed"), F.count_if("hard").alias("n_acceleration"), F.count_if("turned").alias("n_direction_change"),
    )
    seen = sampled.join(masks, ["video", "frame"])
    sure = stored(seen.groupBy("obj_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.5)).alias("mask_confidence"), F.min_by(F.struct("video", "runs"), "pos").alias("first")), "fused-seen")
    named = ml.best_match(spatial_pairs(sure.select("obj_id", "first.*"), boxes, width, height), sure.select("obj_id"))
    steady = tj.temporal_consistency(smooth, "score").join(smooth.groupBy("obj_id").agg(F.avg("score").alias("consistency")), "obj_id")
    j = motion.join(valid, "obj_id").join(sure.select("obj_id", "first.video", "mask_confidence"), "obj_id").join(named.withColumnRenamed("confidence", "label_confidence"), "obj_id").join(steady, "obj_id")
    j = with_quality(j, quality_metrics(masks))
    short = F.col("n_points") < 2
    total = F.col("n_speed") + F.col("n_acceleration") + F.col("n_direction_change")
    return j.select(
        "video", F.concat(F.lit("track_"), F.col("obj_id")).alias("object_id"), "label", "label_confidence", "method", F.col("motion_type").alias("behaviour"), F.when(F.col("n_points") > 10, "high").otherwise("medium").alias("tracking_confidence"),
        "n_points", "duration", "displacement", "mean_speed", *[f"{k}_{c}" for c in tj.AXES for k in ("min", "max")], "mask_confidence", "avg_confidence", "tracking_frames", "consistency", "temporal_consistency",
        ml.cross_modal(F.col("mask_confidence"), F.lit(depth_confidence).cast("double"), F.lit(semantic_confidence).cast("double"), F.col("consistency")).alias("confidence"),
        F.when(short, 0).otherwise(total).alias("total_violations"), F.when(short, "too_short").when(total == 0, "valid").otherwise("invalid").alias("physics_status"),
    )


def results(objects: DataFrame, sampling: DataFrame, depth_confidence: float | None, semantic_confidence: float | None, frames: Column | None = None) -> DataFrame:
    """A result row a job: counts, scene, model averages and how frames were sampled; a mean over nothing is 0.

    ``objects`` are those of ``fuse`` with job_id, ``sampling`` has a row a job: job_id, sampling_strategy, sampled_frames. The masks' mean
    confidence is over all their frames. A job without objects has a row of zeros. ``frames`` counts for the complexity, if not those sampled.
    """
    sums = objects.groupBy("job_id").agg(
        F.count("*").alias("n"), F.try_divide(F.sum(F.col("avg_confidence") * F.col("tracking_frames")), F.sum("tracking_frames")).alias("mean"), (F.min_by("behaviour", "object_id") != "stationary").alias("dynamic"),
    )
    models = [F.coalesce(F.lit(depth_confidence).cast("double"), F.lit(0.0)).alias("depth_avg_confidence"), F.lit(semantic_confidence).cast("double").alias("semantic_confidence")]
    return sampling.join(sums, "job_id", "left").select(
        "job_id", F.lit("success").alias("status"), F.coalesce("n", F.lit(0)).alias("total_objects"), F.coalesce("mean", F.lit(0.0)).alias("mask_avg_confidence"), F.coalesce("dynamic", F.lit(False)).alias("dynamic"),
        (F.coalesce("n", F.lit(0)) * (F.col("sampled_frames") if frames is None else frames) / 100).alias("complexity"), "sampling_strategy", "sampled_frames", *models,
    )


def enriched(objects: DataFrame, job_id: str, sampling: DataFrame, frames: int, depth_confidence: float | None, semantic_confidence: float | None) -> DataFrame:
    """The row of ``results`` of one job; objects that don't tell their frames count alike, by mask_confidence."""
    own = objects if "avg_confidence" in objects.columns else objects.withColumns({"avg_confidence": F.col("mask_confidence"), "tracking_frames": F.lit(1)})
    job = F.lit(job_id)
    return results(own.withColumn("job_id", job), sampling.withColumn("job_id", job), depth_confidence, semantic_confidence, F.lit(frames))


def checked(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job_id, total_frames, size_bytes, ...) -> jobs to run, and an error table (job_id, status, error) of those that can't be."""
    error = F.when(F.col("total_frames").isNull() | F.col("size_bytes").isNull(), "video not found").when(F.col("total_frames") <= 0, "video has no frames")
    marked = jobs.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL").select("job_id", F.lit("error").alias("status"), "error")


def nested(objects: DataFrame) -> DataFrame:
    """Objects of ``fuse`` as nested rows: semantic (label, confidence, method), motion, validation (consistency, temporal_consistency, violations, status), quality (avg_confidence, tracking_frames)."""
    return objects.select(
        "video", "object_id", F.struct("label", F.col("label_confidence").alias("confidence"), "method").alias("semantic"), F.struct("behaviour", "duration", "displacement", "mean_speed").alias("motion"),
        F.struct("consistency", "temporal_consistency", F.col("total_violations").alias("violations"), F.col("physics_status").alias("status")).alias("validation"), F.struct("avg_confidence", "tracking_frames").alias("quality"),
    )


def reliable(results: DataFrame, above: float = 0.7) -> DataFrame:
    """Nested rows whose consistency exceeds ``above``. On a Parquet table this filter, like the two below, reaches the scan, which reads the fields that are used."""
    return results.where(F.col("validation.consistency") > above)


def violating(results: DataFrame) -> DataFrame:
    """Nested rows with physics violations."""
    return results.where(F.col("validation.violations") > 0)


def well_labelled(results: DataFrame, above: float = 0.8) -> DataFrame:
    """Nested rows whose label is surer than ``above``."""
    return results.where(F.col("semantic.confidence") > above)
