"""Boxes that meet in cells, against all pairs and a plain greedy loop."""

import random

import pytest
from pyspark.sql import functions as F

from lumentrack.operators import grid
from lumentrack.operators import masks as mk
from lumentrack.plans import raster

SCHEMA = "frame int, ord int, x double, y double, w double, h double, confidence double"


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


def greedy(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[6], r[1])):
        if all(k[0] != r[0] or iou(k[2:6], r[2:6]) <= t for k in kept):
            kept.append(r)
    return sorted((r[0], r[1]) for r in kept)


@pytest.mark.parametrize("t", [0.05, 0.3, 0.7])
def test_random_boxes(spark, t):
    rng = random.Random(int(t * 100))
    size = lambda: rng.choice([1, 2, 3.5, 8, 40, 400]) * rng.uniform(0.5, 1.5)
    rows = [(k % 3, k, rng.uniform(-50, 100), rng.uniform(-50, 100), size(), size(), rng.choice([0.1, 0.5, 0.9])) for k in range(400)]
    rows += [(0, 400 + k, 5.0, 5.0, 4.0, 4.0, 0.5) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.frame, r.a, r.b, round(r.iou, 9)) for r in grid.box_pairs(df, t).collect())
    assert got == sorted((a[0], a[1], b[1], round(iou(a[2:6], b[2:6]), 9)) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a[2:6], b[2:6]) > t)
    assert sorted((r.frame, r.ord) for r in grid.nms(df, t).collect()) == greedy(rows, t)


def test_boxes_without_area(spark):
    rows = [(1, 1, 0.0, 0.0, 0.0, 5.0, 0.5), (1, 2, 0.0, 0.0, -1.0, 5.0, 0.5), (1, 3, None, 0.0, 5.0, 5.0, 0.5), (1, 4, float("nan"), 0.0, 5.0, 5.0, 0.5), (1, 5, 0.0, 0.0, 5.0, 5.0, 0.5), (1, 6, 0.0, 0.0, 5.0, 5.0, 0.6), (2, 5, 0.0, 0.0, 5.0, 5.0, 0.1)]
    got = sorted((r.frame, r.ord, r.confidence) for r in grid.nms(spark.createDataFrame(rows, SCHEMA), 0.5).collect())
    assert got == [(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.5), (1, 6, 0.6), (2, 5, 0.1)]
    assert grid.nms(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_crowded_frame(spark):
    """A hundred thousand boxes on one frame, a few of which overlap each other, end soon; no row holds a frame."""
    k = F.col("id")
    df = spark.range(100_000).select(F.lit(1).alias("frame"), k.cast("int").alias("ord"), (k % 1000 * 10 + k % 7 * 0.3).alias("x"), (F.floor(k / 1000) * 10 + k % 5 * 0.4).cast("double").alias("y"), F.lit(9.0).alias("w"), (k % 3 + 8).cast("double").alias("h"), (k % 11 / 11).alias("confidence"))
    doubled = df.unionByName(df.withColumn("ord", F.col("ord") + 100_000).withColumn("x", F.col("x") + 0.5))
    assert grid.nms(doubled, 0.7).count() == 100_000


def test_masks_far_apart_do_not_meet(spark):
    runs = "array<struct<y:int,x0:int,x1:int>>"
    wide = [(0, 0, 900)]
    m = spark.createDataFrame([(1, 1, wide), (1, 2, [(0, 100, 900)]), (1, 3, [(0, 950, 960)]), (1, 4, [(0, 0, 899), (1, 5, 6)])], f"frame long, obj_id long, runs {runs}")
    assert sorted((r.a, r.b, round(r.iou, 6)) for r in mk.overlaps(m, 0.5).collect()) == [(1, 2, 0.888889), (1, 4, round(899 / 901, 6)), (2, 4, round(799 / 901, 6))]


@pytest.mark.parametrize("few", [1, 64, 1000])
def test_frames_of_few_boxes_are_decided_in_a_row(spark, few):
    """The same boxes stay on either way, and boxes of small frames are neither joined nor sent to Python; those without a frame are one frame's."""
    rng = random.Random(few)
    rows = [(rng.choice([1, 2, 3, 3, 3, 3]), k, rng.uniform(0, 30), rng.uniform(0, 30), rng.choice([4.0, 9.0]), rng.choice([3.0, 11.0]), rng.choice([0.1, 0.5, 0.9])) for k in range(240)]
    rows += [(9, 300 + k, 1.0, 1.0, 4.0, 4.0, None if k == 3 else 0.5) for k in range(5)]
    want = greedy([r for r in rows if r[0] != 9], 0.3) + [(9, 303)]
    found = grid.nms(spark.createDataFrame(rows, SCHEMA), 0.3, few=few)
    assert sorted((r.frame, r.ord) for r in found.collect()) == want
    if few == 1000:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and plan.count("Join") == plan.count("Join LeftAnti") <= 1
    lost = [(None, *r[1:]) for r in rows if r[0] == 3]
    assert sorted((3, r.ord) for r in grid.nms(spark.createDataFrame(lost, SCHEMA), 0.3, few=few).collect()) == [k for k in want if k[0] == 3]


def test_retention_moves_boxes_once(spark):
    """Its plan joins no boxes, as frames of order lines are small."""
    plan = raster.retention(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("Join Inner") <= 1
