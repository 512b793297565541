"""Masks that meet block by block, against all pairs and a plain greedy loop."""

import random

import pytest

from lumentrack.operators import masks as mk

RUNS = "array<struct<y:int,x0:int,x1:int>>"


def scattered(seed, n, side):
    """(frame, obj_id, ord, confidence, height, width, runs) of masks of several sizes, many of which overlap, over tiles' sides too."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, w, h = rng.randrange(side), rng.randrange(side), rng.choice([3, 9, 40, 150]), rng.choice([2, 5, 30])
        runs = [(y + i, x + rng.randrange(2), x + w - rng.randrange(2)) for i in range(h) if rng.random() < 0.9]
        rows.append((k % 2, k, k, rng.choice([0.2, 0.5, 0.8]), 4 * side, 4 * side, runs))
    return rows


def pixels(row):
    return {(y, x) for y, x0, x1 in row[-1] for x in range(x0, x1)}


def shares(rows):
    every = {r[1]: pixels(r) for r in rows}
    return {(a[0], a[1], b[1]): len(every[a[1]] & every[b[1]]) / len(every[a[1]] | every[b[1]]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and every[a[1]] & every[b[1]]}


@pytest.mark.parametrize("load", [60, 200_000])
def test_pairs_of_blocks(spark, monkeypatch, load):
    """Final rows come from the task where two blocks meet, whatever the blocks' size: no aggregate of pairs follows."""
    monkeypatch.setattr(mk, "LOAD", load)
    monkeypatch.setattr(mk, "BLOCK", 4)
    rows = scattered(3, 120, 90)
    df = spark.createDataFrame([(r[0], r[1], r[-1]) for r in rows] + [(None, 900, [(0, 0, 5)]), (0, 901, []), (1, 902, None)], f"frame int, obj_id long, runs {RUNS}")
    want = shares(rows)
    for above in (0, 0.3):
        found = mk.overlaps(df, above)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0]
        assert {(r.frame, r.a, r.b): round(r.iou, 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items() if v > above}
    assert mk.overlaps(df.where("obj_id < 0"), 0.3).count() == 0


@pytest.mark.parametrize("lead", [5, 512])
def test_suppression_of_crowded_frames(spark, lead):
    """The first of a crowded frame take away what they overlap before any pairs of the others are made."""
    rows = scattered(4, 90, 25) + [(0, 500, 500, 0.9, 100, 100, []), (3, 501, 501, 0.1, 100, 100, [(1, 1, 4)])]
    want = shares(rows)
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[3], r[2])):
        if all(want.get((r[0], *sorted((k[1], r[1]))), 0) <= 0.3 for k in kept if k[0] == r[0]):
            kept.append(r)
    df = spark.createDataFrame(rows, f"frame int, obj_id long, ord long, confidence double, height int, width int, runs {RUNS}")
    assert sorted((r.frame, r.obj_id) for r in mk.nms(df, 0.3, lead=lead).collect()) == sorted((r[0], r[1]) for r in kept)
