"""Streams over several micro-batches give the rows of the batch operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumentrack.operators import masks as mk
from lumentrack.operators import trajectory
from lumentrack.operators.requests import accepted
from lumentrack.streaming import stateful
from lumentrack.streaming.tables import drain, read


@pytest.fixture
def in_parts(spark, tmp_path):
    """Writes rows in several files, one a micro-batch, in order of time."""

    def write(parts, schema, name="t"):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return read(spark, str(tmp_path / name), files=1), spark.read.parquet(str(tmp_path / name))

    return write


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_rate_limit(in_parts):
    parts = [[(1, 0, 0.0), (2, 1, 0.5), (1, 2, 1.0)], [(1, 4, 60.5), (1, 3, 2.0)], [(1, 5, 61.5), (1, 6, 61.6), (2, 7, 61.7)]]
    stream, table = in_parts(parts, "key long, id long, at double")
    got = drain(stateful.rate_limit(stream, 60.0, 2), "t")
    assert rows(got.select("key", "id", "accepted")) == rows(accepted(table, 60.0, 2).select("key", "id", "accepted"))


def test_clamps(in_parts):
    point = lambda o, i: (o, i * 0.1, i, float(i * i % 7), float(i % 3 * o), float(i % 5))
    parts = [[point(o, i) for o in (1, 2) for i in range(a, a + 4)] for a in (0, 4, 8)] + [[(3, 5.0, 0, 1.0, 1.0, 1.0)]]
    stream, table = in_parts(parts, "obj_id long, t double, ord long, x double, y double, z double")
    points = table.select("obj_id", F.col("ord").cast("int").alias("pos"), "t", "x", "y", "z")
    names = ["obj_id", "pos", "x", "y", "z", "hit", "measure"]
    for midpoint in (False, True):
        assert rows(drain(stateful.clamp_speed(stream, 20.0, midpoint), "t").select(names)) == rows(trajectory.clamp_speed(points, 20.0, midpoint).select(names))
    assert rows(drain(stateful.clamp_acceleration(stream, 50.0), "t").select(names)) == rows(trajectory.clamp_acceleration(points, 50.0).select(names))


def test_masks(in_parts):
    stream, _ = in_parts([[(1, 0, 0b1111), (2, 0, 0)], [(1, 1, 0b110000), (1, 2, 0b111), (2, 1, 0)], [(1, 3, 0b1), (1, 4, -1)]], "obj_id long, ord long, bits long")
    assert rows(drain(stateful.temporal_filter(stream, 0.5), "t")) == [(1, 0), (1, 2), (2, 0), (2, 1)]


def test_jobs(in_parts):
    stream, _ = in_parts([[(1, 0, 0, "queued"), (2, 0, 1, "queued")], [(1, 2, 3, "completed"), (1, 1, 2, "processing")], [(1, 3, 4, "cancelled"), (2, 3, 5, "cancelled")]], "job_id long, at long, ord long, state string")
    got = drain(stateful.job_changes(stream, "completed"), "t")
    assert rows(got) == [(1, 0, "queued"), (1, 1, "processing"), (1, 2, "completed"), (2, 0, "queued"), (2, 1, "cancelled")]


RUNS = "array<struct<y:int,x0:int,x1:int>>"


def shuffled(every, parts, seed=5):
    """Rows dealt over micro-batches without regard to their time."""
    rng = random.Random(seed)
    dealt = [[] for _ in range(parts)]
    for row in every:
        rng.choice(dealt).append(row)
    return [p for p in dealt if p]


def test_event_time_clamps(in_parts):
    """Rows out of order across micro-batches are folded as the batch operator folds the sorted track."""
    point = lambda o, i: (o, i * 0.1, i, float(i * i % 7), float(i % 3 * o), float(i % 5))
    parts = shuffled([point(o, i) for o in (1, 2) for i in range(30)], 4) + [[(9, 1e6, 0, 0.0, 0.0, 0.0)]]
    stream, table = in_parts(parts, "obj_id long, t double, ord long, x double, y double, z double")
    points = table.where("obj_id < 9").select("obj_id", F.col("ord").cast("int").alias("pos"), "t", "x", "y", "z")
    names = ["obj_id", "pos", "x", "y", "z", "hit", "measure"]
    got = drain(stateful.clamp_speed(stream, 20.0, delay=100.0), "t").where("obj_id < 9").select(names)
    assert rows(got) == rows(trajectory.clamp_speed(points, 20.0).select(names))
    got = drain(stateful.clamp_acceleration(stream, 50.0, delay=100.0), "t").where("obj_id < 9").select(names)
    assert rows(got) == rows(trajectory.clamp_acceleration(points, 50.0).select(names))


def test_event_time_requests_and_jobs(in_parts):
    parts = shuffled([(k % 3, k, float(k * 7 % 90)) for k in range(40)], 5) + [[(7, 99, 1e6)]]
    stream, table = in_parts(parts, "key long, id long, at double")
    names = ["key", "id", "accepted"]
    assert rows(drain(stateful.rate_limit(stream, 20.0, 2, delay=200.0), "t").where("key < 7").select(names)) == rows(accepted(table.where("key < 7"), 20.0, 2).select(names))


def test_late_rows_are_dropped(in_parts):
    stream, _ = in_parts([[(1, 10, 0, "queued")], [(1, 500, 1, "completed")], [(1, 20, 2, "processing")], [(1, 2000, 3, "x")], [(2, 9000, 4, "y")]], "job_id long, at long, ord long, state string")
    got = drain(stateful.job_changes(stream, "x", delay=50.0), "t")
    assert rows(got.where("job_id = 1")) == [(1, 0, "queued"), (1, 1, "completed"), (1, 2, "x")]


def test_masks_of_any_size(in_parts):
    """Discs on 100 x 100, in shuffled batches and in batches by time, with the quality condition."""

    def disc(cx, cy, r):
        return [(y, cx - math.isqrt(r * r - (y - cy) ** 2), cx + math.isqrt(r * r - (y - cy) ** 2) + 1) for y in range(cy - r, cy + r + 1)]

    every = [(o, k, disc(50 if k % 7 < 5 else 20, 50, 18 + (k + o) % 4)[:: 1 if k % 11 else -1], k % 5 != 3) for o in (1, 2) for k in range(25)] + [(3, 0, [], True), (3, 1, [], None), (3, 2, [], True)]
    for parts, delay in ((shuffled(every, 4) + [[(9, 10_000, [], True)]], 100.0), ([[r for r in every if a <= r[1] < a + 9] for a in (0, 9, 18)], None)):
        stream, table = in_parts(parts, f"obj_id long, frame long, runs {RUNS}, is_valid boolean", f"masks{delay}")
        want = mk.temporal_filter(table.where("obj_id < 9").na.fill(False, ["is_valid"]), 0.5).select("obj_id", "frame")
        assert rows(drain(stateful.mask_filter(stream, 0.5, delay=delay), "t").where("obj_id < 9").select("obj_id", "frame")) == rows(want)
