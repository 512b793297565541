"""Optical flow between gray frames, and the motion scores made of it.

A pixel's flow solves the least-squares equations of its 5 x 5 surroundings (two unknowns, sums of products of slopes and
of the change in time), all in array functions. It measures motion of up to about a pixel a pair;
where the surroundings have no texture to tell a direction, there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.operators.raster import boxes, let, slopes

#: Share of the trace's square that the determinant must exceed.
TEXTURE = 1e-6


def flow(before: Column, after: Column, height: Column, width: Column) -> Column:
    """array<struct<u, v>>: the shift of each pixel along x and y between two row-major gray frames."""

    def products(i):
        (ax, ay), (bx, by) = slopes(before, i, height, width), slopes(after, i, height, width)
        gx, gy, gt = (ax + bx) / 2, (ay + by) / 2, F.get(after, i) - F.get(before, i)
        one = let(F.struct(gx.alias("x"), gy.alias("y"), gt.alias("t")), lambda g: F.struct((g["x"] * g["x"]).alias("a"), (g["x"] * g["y"]).alias("b"), (g["y"] * g["y"]).alias("c"), (g["x"] * g["t"]).alias("d"), (g["y"] * g["t"]).alias("e")))
        return one

    def solve(s):
        det = s["a"] * s["c"] - s["b"] * s["b"]
        told = det > TEXTURE * (s["a"] + s["c"]) * (s["a"] + s["c"])
        safe = F.when(told, det)
        part = lambda p: F.coalesce(p / safe, F.lit(0.0))
        return F.struct(part(s["b"] * s["e"] - s["c"] * s["d"]).alias("u"), part(s["b"] * s["d"] - s["a"] * s["e"]).alias("v"))

    return F.transform(boxes(F.transform(F.sequence(F.lit(0), F.size(before) - 1), products), "abcde", height, width), solve)


def magnitude(field: Column) -> Column:
    """Mean length of the shifts of a flow field."""
    return F.aggregate(field, F.lit(0.0), lambda t, s: t + F.sqrt(s["u"] * s["u"] + s["v"] * s["v"])) / F.size(field)


def motion_magnitude(frames: DataFrame, stride: int = 5) -> DataFrame:
    """(video, frame, height, width, gray array<double>) -> video, frame, score of every ``stride``-th frame: its mean flow from the one analysed before it.

    A video's first frame scores 0. A null or empty frame, one of another size than that before it, or one that is missing can't be read: the scan
    of the video ends there, and it and all later frames score 0. Frames meet by (video, frame), so a long video is spread over tasks.
    """
    analysed = frames.where(F.col("frame") % stride == 0)
    last = analysed.select("video", (F.col("frame") + stride).alias("frame"), F.col("gray").alias("_before"), F.struct("height", "width").alias("_size"))
    pairs = analysed.join(last, ["video", "frame"], "left")
    height, width = F.col("height").cast("int"), F.col("width").cast("int")
    readable = F.coalesce((F.size("gray") > 0) & (F.size("gray") == height * width), F.lit(False))
    paired = (F.col("frame") == 0) | F.coalesce(F.size("_before") == F.size("gray"), F.lit(False)) & F.coalesce(F.col("_size") == F.struct("height", "width"), F.lit(False))
    failed = pairs.where(~(readable & paired)).groupBy("video").agg(F.min("frame").alias("_end"))
    moved = F.when((F.col("frame") > 0) & (F.col("frame") < F.coalesce("_end", F.col("frame") + 1)), magnitude(flow(F.col("_before"), F.col("gray"), height, width))).otherwise(0.0)
    return pairs.join(failed, "video", "left").select("video", "frame", moved.alias("score"))
