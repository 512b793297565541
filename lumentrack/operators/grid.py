"""A grid of cells in which boxes of one frame meet.

A box lives in the cells of its own level, whose side is the power of two that its longer side doesn't exceed, so it covers
four cells at most. Boxes that overlap by a share of ``above`` differ by few levels, as the shorter of two sides is at least that
share of the longer; so a box also visits the cells of the next levels up. A pair that meets in several cells counts
in the one that holds the corner where its overlap begins, so no pair is made twice.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.sources.store import stored

BOX = ("x", "y", "w", "h")
#: Boxes of a frame up to which suppression gathers them into one row. It changes speed only.
FEW = 64


def _sound() -> Column:
    """Whether a box has an area."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300) for c in BOX]
    return finite[0] & finite[1] & finite[2] & finite[3] & (F.col("w") > 0) & (F.col("h") > 0)


def _cells(boxes: DataFrame, up: int) -> DataFrame:
    """A row for each cell of each box, ``up`` levels above its own: (frame, ord, BOX, level, cx, cy)."""
    level = (F.ceil(F.log2(F.greatest("w", "h"))) + up).cast("int")
    at = boxes.withColumn("level", level).withColumn("side", F.pow(F.lit(2.0), F.col("level")))
    span = lambda c, s: F.sequence(F.floor(F.col(c) / F.col("side")), F.floor((F.col(c) + F.col(s)) / F.col("side")))
    return at.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))


def box_pairs(boxes: DataFrame, above: float) -> DataFrame:
    """(frame, a, b, iou) of the boxes (frame, ord, x, y, w, h) of one frame whose IoU exceeds ``above``, which is over 0; each pair once, by the boxes' ord.

    Boxes without an area meet none. Work follows the boxes that share cells; equal boxes all pair with each other, so drop those first.
    """
    if not 0 < above:
        raise ValueError("the share must be over 0")
    own = boxes.where(_sound()).select("frame", "ord", *BOX)
    reach = math.ceil(math.log2(1 / above)) if above < 1 else 0
    homes = _cells(own, 0)
    met = None
    for up in range(reach + 1):
        guests = (_cells(own, up) if up else homes).select("frame", "level", "cx", "cy", F.col("ord").alias("other"), *[F.col(c).alias(f"o{c}") for c in BOX])
        both = homes.join(guests, ["frame", "level", "cx", "cy"])
        both = both.where(F.col("ord") < F.col("other")) if up == 0 else both
        met = both if met is None else met.unionByName(both)
    left, top = F.greatest("x", "ox"), F.greatest("y", "oy")
    width, height = F.least(F.col("x") + F.col("w"), F.col("ox") + F.col("ow")) - left, F.least(F.col("y") + F.col("h"), F.col("oy") + F.col("oh")) - top
    inner = width * height
    union = F.col("w") * F.col("h") + F.col("ow") * F.col("oh") - inner
    here = (F.floor(left / F.col("side")) == F.col("cx")) & (F.floor(top / F.col("side")) == F.col("cy"))
    found = met.where((width > 0) & (height > 0) & here & (inner > above * union))
    return found.select("frame", F.least("ord", "other").alias("a"), F.greatest("ord", "other").alias("b"), (inner / union).alias("iou"))


def _streamed(rows: DataFrame, threshold: float) -> DataFrame:
    """Suppression in frames of any size, by the grid.

    Of equal boxes all but the first go at once. A box that none before it overlaps stays without more ado; only the others stream through a
    task in order, each with the numbers of those before it that overlap it, and the task remembers which of the frame went.
    """
    rank = F.struct((-F.col("confidence")).alias("c"), "ord")
    first = rows.where(_sound()).groupBy("frame", *BOX).agg(F.min(rank).alias("rank")).select("frame", F.col("rank.ord").alias("ord"), *BOX, "rank") if threshold < 1 else rows.where(_sound()).select("frame", "ord", *BOX, rank.alias("rank"))
    ranks = lambda k: first.select("frame", F.col("ord").alias(k), F.col("rank").alias(f"rank_{k}"))
    pairs = box_pairs(first, threshold).join(ranks("a"), ["frame", "a"]).join(ranks("b"), ["frame", "b"])
    ahead = F.col("rank_a") < F.col("rank_b")
    before = pairs.groupBy("frame", F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("ord")).agg(F.collect_list(F.when(ahead, F.col("a")).otherwise(F.col("b"))).alias("before"), F.first(F.when(ahead, F.col("rank_b")).otherwise(F.col("rank_a"))).alias("rank"))
    order = before.repartition("frame").sortWithinPartitions("frame", "rank").select("frame", "ord", "before")
    schema = order.select("frame", "ord").schema

    def run(batches):
        at, gone = object(), set()
        for pdf in batches:
            out = []
            for frame, own, earlier in zip(pdf["frame"], pdf["ord"], pdf["before"], strict=True):
                if frame != at:
                    at, gone = frame, set()
                if any(e not in gone for e in earlier):
                    gone.add(own)
                    out.append((frame, own))
            yield pd.DataFrame(out, columns=["frame", "ord"])

    gone = order.mapInPandas(run, schema)
    stays = first.select("frame", "ord", (-F.col("rank.c")).alias("confidence")).join(gone, ["frame", "ord"], "left_anti")
    return stays.unionByName(rows.where(~_sound() | _sound().isNull()).select("frame", "ord", "confidence"))


def _gathered(rows: DataFrame, threshold: float) -> DataFrame:
    """Suppression in frames of few boxes, each gathered into one row: a box is compared with the kept ones before it."""
    box = F.struct((-F.col("confidence")).alias("c"), "ord", *BOX, "confidence", F.coalesce(_sound(), F.lit(False)).alias("sound"))
    frames = rows.groupBy("frame").agg(F.sort_array(F.collect_list(box)).alias("boxes"))

    def over(a: Column, b: Column) -> Column:
        width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
        height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
        inner = width * height
        return a["sound"] & b["sound"] & (width > 0) & (height > 0) & (inner > threshold * (a["w"] * a["h"] + b["w"] * b["h"] - inner))

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: over(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    return frames.select("frame", F.explode(kept).alias("b")).select("frame", "b.ord", "b.confidence")


def nms(detections: DataFrame, threshold: float = 0.7, few: int = FEW) -> DataFrame:
    """Greedy suppression in each frame: (frame, ord, confidence) of the boxes that stay. By confidence descending, then ord, a box stays unless a kept one overlaps it by more than ``threshold``.

    Frames of up to ``few`` boxes are decided in a row each, so their boxes are moved once; those of more go by the grid. Boxes without an area
    overlap nothing and stay. Boxes without a frame are of one frame.
    """
    if not 0 < threshold:
        raise ValueError("the share must be over 0")
    rows = detections.select("frame", "ord", *[F.col(c).cast("double").alias(c) for c in BOX], "confidence")
    crowded = stored(rows.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") > few).select(F.col("frame").alias("full")), "crowded-frames")
    full = F.col("frame").eqNullSafe(F.col("full"))
    stay = _gathered(rows.join(crowded, full, "left_anti"), threshold)
    if crowded.isEmpty():
        return stay
    many = stored(rows.join(crowded, full, "left_semi"), "crowded-boxes")
    stay = stay.unionByName(_streamed(many.where("frame IS NOT NULL"), threshold))
    if crowded.where("full IS NULL").isEmpty():
        return stay
    kind = many.schema["frame"].dataType
    lost = _streamed(many.where("frame IS NULL").withColumn("frame", F.lit(0).cast(kind)), threshold)
    return stay.unionByName(lost.withColumn("frame", F.lit(None).cast(kind)))
