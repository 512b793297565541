"""Values known in closed form, or worked out by hand, for masks, texts, physics, consistency and sampling."""

import math

import pytest
from pyspark.sql import functions as F

from lumentrack.operators import fusion as fu
from lumentrack.operators import masks as mk
from lumentrack.operators import physics as ph
from lumentrack.operators import raster as ra
from lumentrack.operators import sampling as fr
from lumentrack.operators import semantic as ml

RUNS = "array<struct<y:int,x0:int,x1:int>>"


def disc(cx, cy, r):
    out = []
    for y in range(cy - r, cy + r + 1):
        w = math.isqrt(r * r - (y - cy) ** 2)
        out.append((y, cx - w, cx + w + 1))
    return out


def square(x0, y0, n):
    return [(y, x0, x0 + n) for y in range(y0, y0 + n)]


def frame_masks(spark, rows):
    """(frame, obj_id, ord, runs, confidence) on frames of 100 x 100."""
    return spark.createDataFrame([(*r[:3], 100, 100, *r[3:]) for r in rows], f"frame long, obj_id long, ord long, height int, width int, runs {RUNS}, confidence double")


def test_runs(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, -1.0, 0.0, 3.0, 4.0]), (2, []), (3, [-1.0] * 6), (4, [1.0] * 6), (5, [None, 1.0, 1.0, 0.6, 0.4, None])], "id int, v array<double>")
    got = {r.id: [tuple(s) for s in r.runs] for r in rows.select("id", mk.runs(F.col("v"), 3).alias("runs")).collect()}
    assert got == {1: [(0, 0, 2), (1, 1, 3)], 2: [], 3: [], 4: [(0, 0, 3), (1, 0, 3)], 5: [(0, 1, 3), (1, 0, 2)]}
    half = rows.where("id = 5").select(mk.runs(F.col("v"), 3, above=0.5).alias("r")).first().r
    assert [tuple(s) for s in half] == [(0, 1, 3), (1, 0, 1)]


def test_overlap_of_discs(spark):
    assert mk.run_iou(disc(50, 50, 20), disc(52, 50, 20)) == pytest.approx(0.880329, abs=1e-6)
    assert mk.run_iou([], []) == 1.0 and mk.run_iou([], disc(50, 50, 2)) == 0.0
    m = frame_masks(spark, [(0, 1, 0, disc(50, 50, 20), 0.9), (0, 2, 1, disc(52, 50, 20), 0.7), (0, 3, 2, disc(80, 80, 15), 0.8), (0, 4, 3, [], 0.1), (1, 5, 0, disc(50, 50, 20), 0.5)])
    (pair,) = mk.overlaps(m, 0.5).collect()
    assert (pair.frame, pair.a, pair.b, round(pair.iou, 6)) == (0, 1, 2, 0.880329)
    assert {r.obj_id for r in mk.nms(m, 0.7).collect()} == {1, 3, 4, 5}


def test_suppression_chain_and_ties(spark):
    """A suppressed mask suppresses nothing; of equal confidences the earlier ord stays."""
    m = frame_masks(spark, [(0, 1, 0, square(0, 0, 10), 0.9), (0, 2, 1, square(4, 0, 10), 0.8), (0, 3, 2, square(8, 0, 10), 0.7), (1, 1, 5, square(0, 0, 10), 0.5), (1, 2, 4, square(0, 0, 10), 0.5)])
    assert {(r.frame, r.obj_id) for r in mk.nms(m, 0.4).collect()} == {(0, 1), (0, 3), (1, 2)}


def test_area_and_temporal_filter(spark):
    m = frame_masks(spark, [(0, 1, 0, disc(50, 50, 20), 0.9), (1, 1, 0, disc(52, 50, 20), 0.9), (0, 2, 1, square(50, 50, 3), 0.9), (1, 2, 1, square(50, 50, 3), 0.9)])
    assert {(r.frame, r.obj_id) for r in mk.min_area(m).collect()} == {(0, 1), (1, 1)}
    valid = mk.area(F.col("runs")) / 10000 >= 0.001
    assert {(r.frame, r.obj_id) for r in mk.temporal_filter(m.withColumn("is_valid", valid)).collect()} == {(0, 1), (1, 1)}
    jump = frame_masks(spark, [(k, 1, 0, disc(50, 50, 20) if k < 2 or k > 4 else disc(20, 20, 10), 0.9) for k in range(7)]).withColumn("is_valid", F.lit(True))
    assert sorted(r.frame for r in mk.temporal_filter(jump).collect()) == [0, 1, 5, 6]
    assert sorted(r.frame for r in mk.temporal_filter(jump.withColumn("is_valid", F.col("frame") != 0)).collect()) == [1, 5, 6]


def test_two_squares(spark):
    on = {(y, x) for k in (10, 80) for y in range(k, k + 5) for x in range(k, k + 5)}
    logits = [1.0 if (y, x) in on else -1.0 for y in range(100) for x in range(100)]
    r = spark.createDataFrame([(1, 0, logits)], "mask_id long, frame int, logits array<double>")
    s = ra.mask_shape(r, width=100).first()
    assert (s.n_components, s.fragmentation, s.edge, s.compactness) == (2, 0.5, 1.0, 1.0)
    from lumentrack.sources.adapters import pixels

    t = ra.mask_stats(pixels(r, 100)).first()
    assert (t.area, round(t.coverage, 6)) == (50, 0.005)
    score = spark.range(1).select(ra.coverage_score(F.lit(0.005)).alias("c")).first().c
    overall = sum(w * p for w, p in zip(ra.WEIGHTS, (score, 1.0, 1.0, 0.5, t.aspect)))
    assert round(score, 3) == 0.444 and overall == pytest.approx(0.666936, abs=1e-5)


def test_text_confidence(spark):
    long = '{"objects": [{"movement": "left", "position": [1, 2]}], "trajectories": [{"id": "a1"}]}'
    texts = [(1, long), (2, "I'm sorry, I cannot detect any objects in this video."), (3, '{"objects": [{"label": "robot"}]}'), (4, "Error: cannot process"), (5, None), (6, "We DON'T KNOW"), (7, "invalid, clearly visible" + " " * 60)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r.id: round(r.c, 6) for r in df.select("id", ml.text_confidence(F.col("text")).alias("c")).collect()}
    assert got == {1: 0.8855, 2: 0.1323, 3: 0.40425, 4: 0.063, 5: 0.175, 6: 0.105, 7: 0.35}


def test_parse_and_fallback_labels(spark):
    t = spark.createDataFrame([(1, "x {a} y", 1.0), (2, "no braces", 1.0), (3, 'so {"a":1} ok', 1.0), (4, None, 1.0)], "id int, text string, confidence double")
    assert {r.id: (r.parse_success, round(r.confidence, 6)) for r in ml.parsed(t).collect()} == {1: (False, 0.3), 2: (False, 0.2), 3: (True, 1.0), 4: (False, 0.2)}
    t = spark.createDataFrame([(1, '{"trajectories":[{"object_id":"arm","action":"lifts"}],"objects":[{"label":"x"}]}'), (2, '{"trajectories":[],"objects":[3,{"label":"ball","behavior":"rolls"}]}'), (3, "none")], "id int, text string")
    o = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "id int, obj_id int")
    assert {r.id: (r.label, r.behaviour) for r in ml.fallback_label(t, o).collect()} == {1: ("arm", "lifts"), 2: ("ball", "rolls"), 3: ("object_9", "stationary")}


def test_consistency(spark):
    rows = [(1, disc(50, 50, 20), [2.5] * 10000, (30.0, 30.0, 40.0, 40.0)), (2, [], [2.5] * 10000, (30.0, 30.0, 40.0, 40.0)), (3, disc(50, 50, 20), [2.5] * 10000, None)]
    df = spark.createDataFrame(rows, f"id int, runs {RUNS}, depth array<double>, box struct<x:double,y:double,w:double,h:double>")
    got = {r.id: r for r in fu.consistency(df, 100, 100).collect()}
    assert round(got[1].spatial_iou, 6) == 0.783396 and got[1].depth_consistency == 1.0 and got[1].is_consistent
    assert (got[2].spatial_iou, got[2].depth_consistency, got[2].is_consistent) == (0.0, 0.0, False)
    assert (got[3].spatial_iou, got[3].centroid_distance, got[3].overall_consistency) == (1.0, 0.0, 1.0)
    scored = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.49)], "id int, overall_consistency double")
    assert [r.id for r in fu.consistent(scored).collect()] == [1]


def test_cross_modal(spark):
    rows = spark.createDataFrame([(0.9, 0.85, 0.8, 0.9), (0.3, 0.4, 0.35, 0.2), (0.87, 0.82, 0.75, 0.79), (0.0, 0.5, 0.5, 0.5)], "s double, d double, c double, k double")
    got = [round(r.v, 6) for r in rows.select(ml.cross_modal(*map(F.col, "sdck")).alias("v")).collect()]
    assert got == [0.811285, 0.205512, 0.731633, 0.7]


def test_label_of_a_disc(spark):
    boxes = spark.createDataFrame([(0, 0, "none", None), (0, 1, "robot", (30.0, 30.0, 40.0, 40.0))], "video int, ord int, label string, box struct<x:double,y:double,w:double,h:double>")
    m = spark.createDataFrame([(0, 1, disc(50, 50, 20)), (0, 2, [])], f"video int, obj_id int, runs {RUNS}")
    got = {r.obj_id: (r.label, round(r.confidence, 6), r.method) for r in ml.best_match(fu.spatial_pairs(m, boxes, 100, 100), m.select("obj_id")).collect()}
    assert got == {1: ("robot", 0.940075, "spatial"), 2: ("object_2", 0.5, "fallback")}


def test_physics_report(spark):
    points = [(1, k, 0.1 * k, float(k), 0.0, 1.0) for k in range(3)]
    points += [(2, 0, 0.0, 0.0, 0.0, 0.0)] + [(3, k, float(k), x, 0.0, 0.0) for k, x in enumerate((0.0, 1.0, 0.0))] + [(4, k, float(k), 0.0, 0.0, z) for k, z in enumerate((0.0, 5.0, 0.0, 5.0, 0.0, 5.0))]
    points += [(5, k, float(k), x, 0.0, 0.0) for k, x in enumerate((0.0, 1.0, 100.0, 100.0))]
    df = spark.createDataFrame(points, "obj_id int, pos int, t double, x double, y double, z double")
    classes = spark.createDataFrame([(1, "HUMAN"), (2, "robot"), (3, "robot"), (4, "ball"), (5, "teapot")], "obj_id int, object_class string")
    got = {r.obj_id: r for r in ph.report(df, classes, ph.limits(spark), "metres").collect()}
    assert (got[1].status, got[1].total_violations) == ("valid", 0)  # ten metres a second are not over ten
    assert (got[2].status, got[2].total_violations) == ("too_short", 0)
    assert (got[3].n_direction_change, got[3].status, got[3].frames_corrected) == (1, "invalid", 0)
    assert (got[4].n_gravity, got[4].n_speed) == (1, 0)
    assert (got[5].n_speed, got[5].frames_corrected >= 2) == (2, True)  # twenty metres a second at most, twice
    assert {r.obj_id: r.max_speed for r in ph.with_limits(classes, ph.limits(spark)).collect()} == {1: 10.0, 2: 5.0, 3: 5.0, 4: 30.0, 5: 20.0}
    pixels = ph.report(df.withColumns({"x": F.col("x") * 100, "y": F.col("y") * 100}), classes, ph.limits(spark))
    assert {r.obj_id: r.total_violations for r in pixels.collect()} == {k: r.total_violations for k, r in got.items()}


def test_fold_of_a_long_track(spark):
    """A track holding most rows streams through; its outputs follow from the outputs before."""
    from lumentrack.operators.trajectory import clamp_speed

    rows = spark.range(30000).select((F.when(F.col("id") < 20000, 0).otherwise(F.col("id"))).cast("int").alias("obj_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("double").alias("t"), (F.col("id") * 3.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    out = clamp_speed(rows, 2.0)
    assert out.count() == 30000 and out.where("obj_id = 0").agg(F.max("x")).first()[0] == pytest.approx(2.0 * 19999)


def test_extraction_and_fallback(spark):
    totals = spark.createDataFrame([(1, 30), (2, 3), (3, 1)], "video int, total int")
    got = {}
    for r in fr.extract(totals, 16).collect():
        got.setdefault(r.video, []).append(r.frame)
    assert sorted(got[1]) == [0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29] and sorted(got[2]) == [0, 1, 2] and got[3] == [0]
    with pytest.raises(Exception, match="no frames"):
        fr.extract(spark.createDataFrame([(1, 0)], "video int, total int")).collect()
    scores = spark.createDataFrame([(1, f, 0.0) for f in range(30)], "video int, frame int, score double")
    bins = spark.createDataFrame([(1, 0, 1, 5), (1, 10, 1, 5), (1, 20, 7, 5)], "video int, frame int, bin int, n int")
    assert {(r.video, r.frame) for r in fr.scene_changes(bins, totals).collect()} == {(1, 0), (1, 20), (1, 29), (2, 0), (2, 2), (3, 0)}
    frames, meta = fr.sample(scores, bins, totals, 32, 16)
    m = {r.video: r for r in meta.collect()}
    assert (m[1].sampling_strategy, m[1].motion_segments, m[1].scene_changes, m[2].sampling_strategy, m[2].motion_segments) == ("adaptive_motion_based", 1, 3, "uniform_fallback", None)
    assert {r.frame for r in frames.where("video = 1").collect()} >= {0, 20, 28, 29} and m[1].sampled_frames >= 16


def test_error_table_and_result(spark):
    jobs = spark.createDataFrame([("a", 30, 5), ("b", None, None), ("c", 0, 5)], "job_id string, total_frames int, size_bytes long")
    good, bad = fu.checked(jobs)
    assert [r.job_id for r in good.collect()] == ["a"] and {r.job_id: r.error for r in bad.collect()} == {"b": "video not found", "c": "video has no frames"}
    none = spark.createDataFrame([], "object_id string, behaviour string, mask_confidence double")
    sampling = spark.createDataFrame([("uniform_fallback", 4)], "sampling_strategy string, sampled_frames int")
    r = fu.enriched(none, "j", sampling, 4, None, 0.5).first()
    assert (r.total_objects, r.mask_avg_confidence, r.dynamic, r.complexity, r.depth_avg_confidence) == (0, 0.0, False, 0.0, 0.0)


def test_answers_of_all_shapes(spark):
    """The first present key ends the search, also without a list; whole lists count; empty aliases fall through, but not a text of a zero."""
    texts = {
        1: '{"objects":"none","trajectories":[{"label":"x"}]}', 2: '{"trajectories":{"label":"x"},"detections":[{"label":"y"}]}', 3: '[{"label":"a"},7,{"class":"b"}]', 4: '{"detections":[{"label":"","object_id":0,"class":"0"},{"label":[],"box":{},"bbox":[1]}]}',
        5: '{"objects":null,"detections":[{"label":"y"}]}', 6: 'so {"objects":[{"label":5,"confidence":"high"},{"confidence":null},{"confidence":0.25}]} it is', 7: "none", 8: None, 9: '{"objects":[]}', 10: "[1,2", 11: '{"a":1}',
    }
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = sorted((r.id, r.ord, r.label, r.bbox, r.confidence) for r in ml.json_objects(df).collect())
    assert got == [(3, 0, "a", None, 1.0), (3, 2, "b", None, 1.0), (4, 0, "0", None, 1.0), (4, 1, "unknown", "[1]", 1.0), (6, 0, "5", None, None), (6, 1, "unknown", None, None), (6, 2, "unknown", None, 0.25)]
    labels = {1: '{"trajectories":[3],"objects":[{"label":"x"}]}', 2: '{"trajectories":"","objects":[4,{"object_id":"","label":"x","behavior":"rolls"}]}', 3: '{"trajectories":[{"object_id":"object_3","action":"","behavior":"turns"}]}', 4: '{"trajectories":{"a":1},"objects":[{"label":"x"}]}', 5: None}
    t = spark.createDataFrame(list(labels.items()), "id int, text string")
    o = spark.createDataFrame([(k, k) for k in labels], "id int, obj_id int")
    assert {r.id: (r.label, r.behaviour) for r in ml.fallback_label(t, o).collect()} == {1: ("object_1", "stationary"), 2: ("x", "rolls"), 3: ("object_3", "turns"), 4: ("object_4", "stationary"), 5: ("object_5", "stationary")}
