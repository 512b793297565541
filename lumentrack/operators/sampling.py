"""Frame sampling: score series to classes, segments, budgets and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of motion: upper bound of the score and stride of the class (fixed values).
CLASSES = (("static", 1.0, 20), ("low", 5.0, 10), ("medium", 15.0, 5), ("high", None, 2))


def uniform(total: Column, n: int) -> Column:
    """``n`` evenly spaced frame numbers from 0 to total - 1, rounded down; they repeat if n > total."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, total - 1).otherwise(F.floor(i * ((total - 1) / F.lit(max(1, n - 1)))).cast("int")))


def motion_class(score: Column) -> Column:
    out = None
    for name, bound, _ in CLASSES[:-1]:
        out = F.when(score < bound, name) if out is None else out.when(score < bound, name)
    return out.otherwise(CLASSES[-1][0])


def fill_scores(analysed: DataFrame, totals: DataFrame) -> DataFrame:
    """(video, frame, score) of analysed frames -> every frame: linear between neighbours, the last value held after them."""
    every = totals.select("video", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("frame")).join(analysed, ["video", "frame"], "left")
    w = Window.partitionBy("video").orderBy("frame")
    own = F.when(F.col("score").isNotNull(), F.struct("frame", "score"))
    p = every.withColumn("a", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    share = (F.col("frame") - F.col("a.frame")) / F.when(F.col("b.frame") > F.col("a.frame"), F.col("b.frame") - F.col("a.frame"))
    return p.select("video", "frame", F.coalesce(F.col("score"), F.col("a.score") + share * (F.col("b.score") - F.col("a.score")), F.col("a.score"), F.col("b.score"), F.lit(0.0)).alias("score"))


def segments(scores: DataFrame) -> DataFrame:
    """Runs of one motion class: (video, start, end exclusive, class, intensity). A video's last frame belongs to no segment."""
    w = Window.partitionBy("video").orderBy("frame")
    p = scores.withColumn("class", motion_class(F.col("score"))).withColumn("last", F.max("frame").over(Window.partitionBy("video"))).where("frame < last")
    p = p.withColumn("island", F.sum(F.coalesce((F.col("class") != F.lag("class").over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("video", "island").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.first("class").alias("class"), F.avg("score").alias("intensity")).drop("island")


def allocate(segs: DataFrame, scenes: DataFrame, totals: DataFrame, most: int = 32, least: int = 16) -> DataFrame:
    """(video, frame): strides of each segment, its ends and the scene changes; thinned evenly to ``most``, then joined by a uniform sample if under ``least``."""
    stride = F.create_map(*[x for name, _, s in CLASSES for x in (F.lit(name), F.lit(s))])[F.col("class")]
    inner = segs.select("video", F.explode(F.concat(F.sequence(F.col("start").cast("int"), F.col("end").cast("int") - 1, stride), F.array(F.col("end").cast("int") - 1))).alias("frame"))
    every = inner.unionByName(scenes.select("video", F.col("frame").cast("int").alias("frame"))).distinct()
    n = F.count("*").over(Window.partitionBy("video"))
    ranked = every.withColumn("n", n).withColumn("rank", F.row_number().over(Window.partitionBy("video").orderBy("frame")) - 1)
    # place i of the thinned sample is rank floor(i * n / most): a rank is picked if such an i exists
    slot = F.ceil(F.col("rank") * most / F.col("n"))
    picked = ranked.where((F.col("n") <= most) | ((slot < most) & (F.floor(slot * F.col("n") / most) == F.col("rank"))))
    short = totals.join(picked.groupBy("video").agg(F.count("*").alias("k")), "video", "left").where(F.coalesce("k", F.lit(0)) < least)
    return picked.select("video", "frame").unionByName(short.select("video", F.explode(uniform(F.col("total").cast("int"), least)).alias("frame"))).distinct()


def scene_distances(bins: DataFrame) -> DataFrame:
    """(video, frame, bin, n) histograms -> (video, frame, distance): chi-square of a frame's normalised histogram from that of the frame before it."""
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("video", "frame")))
    h = bins.select("video", "frame", "bin", (F.col("n") / norm).alias("v"))
    frames = h.select("video", "frame").distinct().withColumn("next", F.lead("frame").over(Window.partitionBy("video").orderBy("frame")))
    before = h.join(frames, ["video", "frame"]).where("next IS NOT NULL").select("video", F.col("next").alias("frame"), "bin", F.col("v").alias("p"))
    return before.join(h, ["video", "frame", "bin"], "left").groupBy("video", "frame").agg(F.sum(F.pow(F.col("p") - F.coalesce("v", F.lit(0.0)), 2) / F.col("p")).alias("distance"))


def scene_changes(bins: DataFrame, totals: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(video, frame): frames whose histogram is over ``threshold`` from the one before, and always a video's first and last frame."""
    ends = totals.select("video", F.explode(F.array(F.lit(0).cast("long"), F.col("total").cast("long") - 1)).alias("frame"))
    return scene_distances(bins).where(F.col("distance") > threshold).select("video", F.col("frame").cast("long").alias("frame")).union(ends).distinct()


def extract(totals: DataFrame, most: int = 32) -> DataFrame:
    """(video, i, frame): at most ``most`` evenly spaced frames of each video, never more than it has; a video without frames is an error."""
    n = F.least(F.lit(most), F.col("total").cast("int"))
    checked = totals.withColumn("n", F.when(F.col("total") > 0, n).otherwise(F.raise_error(F.lit("video has no frames")).cast("int")))
    places = checked.select("video", "total", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    frame = F.when(F.col("i") == F.col("n") - 1, F.col("total") - 1).otherwise(F.floor(F.col("i") * ((F.col("total") - 1) / F.greatest(F.lit(1), F.col("n") - 1))))
    return places.select("video", "i", F.when(F.col("n") == 1, 0).otherwise(frame).cast("int").alias("frame"))


def sample(scores: DataFrame, bins: DataFrame, totals: DataFrame, most: int = 32, least: int = 16) -> tuple[DataFrame, DataFrame]:
    """Frames of each video, and their metadata.

    Videos with motion scores are sampled by motion: (video, frame) of segments, scene changes and
    budget. Those without (analysis failed) fall back to a uniform sample of ``most`` frames. Metadata: video, total_frames,
    sampled_frames, motion_segments, scene_changes, avg_motion_intensity, sampling_strategy.
    """
    found, scenes = segments(scores), scene_changes(bins, totals)
    known = scores.groupBy("video").agg(F.avg("score").alias("avg_motion_intensity"))
    moving = totals.join(known.select("video"), "video", "left_semi")
    still = totals.join(known.select("video"), "video", "left_anti")
    frames = allocate(found, scenes.join(known.select("video"), "video", "left_semi"), moving, most, least)
    frames = frames.unionByName(still.select("video", F.explode(F.array_distinct(uniform(F.col("total").cast("int"), most))).alias("frame")))
    count = lambda df, name: df.groupBy("video").agg(F.count("*").alias(name))
    meta = totals.join(count(frames, "sampled_frames"), "video", "left").join(count(found, "motion_segments"), "video", "left").join(count(scenes, "scene_changes"), "video", "left").join(known, "video", "left")
    seen = F.col("avg_motion_intensity").isNotNull()
    return frames, meta.select(
        "video", F.col("total").alias("total_frames"), F.coalesce("sampled_frames", F.lit(0)).alias("sampled_frames"), *[F.when(seen, F.coalesce(c, F.lit(0))).alias(c) for c in ("motion_segments", "scene_changes")],
        "avg_motion_intensity", F.when(seen, "adaptive_motion_based").otherwise("uniform_fallback").alias("sampling_strategy"),
    )


def prompt_grid(videos: DataFrame) -> DataFrame:
    """(video, width, height, n) -> video, obj_id, x, y: n x n prompt points inside a tenth of margin, x outermost, numbered from 1; for n = 0 the centre, in whole pixels."""
    n, i, j = F.col("n"), F.floor(F.col("k") / F.greatest("n", F.lit(1))), F.col("k") % F.greatest("n", F.lit(1))
    at = lambda i, size: F.when(n == 0, F.floor(size / 2)).otherwise(0.1 * size + i * (0.8 * size / F.greatest(n - 1, F.lit(1))))
    k = F.explode(F.sequence(F.lit(0), F.greatest(n * n, F.lit(1)) - 1))
    return videos.withColumn("k", k).select("video", (F.col("k") + 1).cast("int").alias("obj_id"), at(i, F.col("width")).cast("double").alias("x"), at(j, F.col("height")).cast("double").alias("y"))
