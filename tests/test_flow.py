"""Known shifts, frames that can't be read, and scores that feed the sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrack.operators import flow as fl
from lumentrack.operators import sampling as fr

SCHEMA = "video int, frame int, height int, width int, gray array<double>"


def pattern(dx, dy, h=40, w=50):
    y, x = np.mgrid[:h, :w]
    x, y = x - dx, y - dy
    return [float(v) for v in (100 + 40 * np.sin(x / 4) * np.cos(y / 5) + 30 * np.sin((x + y) / 6)).ravel()]


@pytest.mark.parametrize(("dx", "dy"), [(1.0, 0.0), (0.0, -1.0), (0.5, 0.25), (0.0, 0.0)])
def test_shifts(spark, dx, dy):
    df = spark.createDataFrame([(pattern(0, 0), pattern(dx, dy))], "a array<double>, b array<double>")
    field = df.select(F.explode(fl.flow(F.col("a"), F.col("b"), F.lit(40), F.lit(50))).alias("s")).select("s.*").toPandas()
    assert field["u"].median() == pytest.approx(dx, abs=0.06) and field["v"].median() == pytest.approx(dy, abs=0.06)
    got = df.select(fl.magnitude(fl.flow(F.col("a"), F.col("b"), F.lit(40), F.lit(50))).alias("m")).first().m
    assert got == pytest.approx(np.hypot(dx, dy), abs=0.1)


def test_scan_ends_where_a_frame_fails(spark):
    rows = [(1, k, 40, 50, pattern(k * 0.1, 0)) for k in range(0, 31)] + [(2, k, 40, 50, None if k == 10 else pattern(k * 0.1, 0)) for k in range(0, 31)]
    rows += [(3, k, 40, 50, pattern(k * 0.1, 0)) for k in (0, 5, 15, 20)] + [(4, 0, 40, 50, []), (5, 0, 1, 1, [7.0]), (5, 5, 40, 50, pattern(0, 0)), (6, 0, 2, 2, [5.0] * 4), (6, 5, 2, 2, [9.0] * 4)]
    got = {(r.video, r.frame): round(r.score, 1) for r in fl.motion_magnitude(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{(1, k): 0.5 * (k > 0) for k in range(0, 31, 5)}, **{(2, k): 0.5 * (k == 5) for k in range(0, 31, 5)}, (3, 0): 0, (3, 5): 0.5, (3, 15): 0, (3, 20): 0, (4, 0): 0, (5, 0): 0, (5, 5): 0, (6, 0): 0, (6, 5): 0}


def test_scores_fill_all_frames(spark):
    df = spark.createDataFrame([(1, k, 40, 50, pattern(k * 0.1 if k < 15 else 1.5, 0)) for k in range(0, 21)], SCHEMA)
    every = fr.fill_scores(fl.motion_magnitude(df), df.groupBy("video").agg(F.count("*").cast("int").alias("total")))
    got = {r.frame: round(r.score, 1) for r in every.collect()}
    assert [got[k] for k in (0, 5, 10, 15, 20)] == [0, 0.5, 0.5, 0.5, 0] and len(got) == 21
