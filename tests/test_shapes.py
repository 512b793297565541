"""Shapes from runs against a pixel-by-pixel flood fill and border walk."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrack.operators import masks as mk
from lumentrack.operators import raster as ra
from lumentrack.operators import shapes

RUNS = "array<struct<y:int,x0:int,x1:int>>"
RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def walked(mask):
    """(perimeter, components) by filling and walking."""
    h, w = mask.shape
    label, n, best = np.zeros((h, w), dtype=int), 0, (-1.0, 0.0)
    inside = lambda p: 0 <= p[0] < h and 0 <= p[1] < w and mask[p]
    for start in map(tuple, np.argwhere(mask)):
        if label[start]:
            continue
        n += 1
        stack, label[start] = [start], n
        while stack:
            p = stack.pop()
            for q in ((p[0] + a, p[1] + b) for a, b in RING):
                if inside(q) and not label[q]:
                    label[q] = n
                    stack.append(q)
        path, p, back, first = [start], start, 4, None
        while True:
            step = next((k % 8 for k in range(back + 1, back + 9) if inside((p[0] + RING[k % 8][0], p[1] + RING[k % 8][1]))), None)
            if step is None or (p, step) == first:
                break
            first = first or (p, step)
            p = (p[0] + RING[step][0], p[1] + RING[step][1])
            path.append(p)
            back = (step + 4) % 8
        ys, xs = np.array(path, float).T
        best = max(best, (abs(float((xs[:-1] * ys[1:] - xs[1:] * ys[:-1]).sum())) / 2, round(float(np.hypot(np.diff(ys), np.diff(xs)).sum()), 9)))
    return (best[1] if n else 0.0), n


def edges(mask):
    if min(mask.shape) < 2:
        return None
    p = np.pad(mask.astype(int), 1, mode="reflect")
    down = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    across = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    return float(bool(down.any() or across.any()))


def measured(rasters):
    mask, y, x0, x1 = [], [], [], []
    for k, r in enumerate(rasters):
        for row in range(r.shape[0]):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], r[row].astype(int), [0]])))
            for a, b in edge.reshape(-1, 2):
                mask.append(k), y.append(row), x0.append(a), x1.append(b)
    size = lambda axis: np.array([r.shape[axis] for r in rasters])
    return shapes.measure(size(0), size(1), *(np.array(v, dtype=int) for v in (mask, y, x0, x1)))


def test_random_rasters():
    rng = np.random.default_rng(1)
    rasters = [rng.random((rng.integers(2, 14), rng.integers(2, 14))) < p for p in (0.1, 0.3, 0.5, 0.7, 0.9) for _ in range(400)]
    stripes = np.zeros((8, 8), bool)
    stripes[:, ::2] = True
    rasters += [stripes, stripes.T, np.zeros((3, 5), bool), np.ones((3, 5), bool), np.indices((6, 6)).sum(axis=0) % 2 == 0, np.pad(np.ones((3, 3), bool), 2) ^ np.pad(np.ones((1, 1), bool), 3)]
    got = measured(rasters)
    for k, r in enumerate(rasters):
        length, n = walked(r)
        assert got["n_components"][k] == n and got["edge"][k] == edges(r), r
        assert got["perimeter"][k] == pytest.approx(length, abs=1e-6), r


def test_large_frames(spark):
    """A disc with a hole, a square inside the hole, and a snake over 1000 x 1000; empty and null masks, runs that touch or leave the frame."""
    disc = [(y, 500 - math.isqrt(400**2 - (y - 500) ** 2), 501 + math.isqrt(400**2 - (y - 500) ** 2)) for y in range(100, 901)]
    ring = [s for y, a, b in disc for s in ([(y, a, 300), (y, 700, b)] if 300 <= y < 700 else [(y, a, b)])]
    square = [(y, 450, 550) for y in range(450, 550)]
    snake = [(y, 0, 1000) if y % 2 == 0 else ((y, 999, 1000) if y % 4 == 1 else (y, 0, 1)) for y in range(999)]
    rows = [(1, disc), (2, ring), (3, ring + square), (4, snake), (5, []), (6, None), (7, [(0, 0, 3), (0, 3, 6), (0, 2, 4), (5, -4, 2000), (-1, 0, 5), (1000, 0, 5)])]
    df = spark.createDataFrame([(k, 1000, 1000, r, "x") for k, r in rows], f"mask_id long, height int, width int, runs {RUNS}, edge_ string")
    got = {r.mask_id: r for r in shapes.mask_shape(df).collect()}
    assert got[1].perimeter == got[2].perimeter == got[3].perimeter and 2000 < got[1].perimeter < 2 * math.pi * 430
    assert (got[1].n_components, got[2].n_components, got[3].n_components, got[3].fragmentation) == (1, 1, 2, 0.5)
    assert got[2].compactness < got[1].compactness
    assert got[4].n_components == 1 and got[4].edge == 1.0
    assert got[5][-5:] == got[6][-5:] == (0.0, 0.0, 0, 1.0, 0.0)
    assert (got[7].perimeter, got[7].n_components) == (2 * 999.0, 2)
    assert shapes.mask_shape(df.limit(0)).count() == 0


def test_quality_of_a_disc(spark):
    """Scores on 100 x 100, as for a raster of pixels."""
    rng = np.random.default_rng(2)
    yy, xx = np.mgrid[:100, :100]
    on = ((yy - 50) ** 2 / 20**2 + (xx - 40) ** 2 / 9**2 <= 1) | (rng.random((100, 100)) < 0.001)
    r = spark.createDataFrame([(1, 0, [float(v) for v in np.where(on, 1.0, -1.0).ravel()])], "mask_id long, frame int, logits array<double>")
    q = ra.mask_quality(ra.as_runs(r, 100)).first()
    ys, xs = np.nonzero(on)
    low, high = np.linalg.eigvalsh(np.cov(np.vstack([ys, xs])))
    assert q.aspect == pytest.approx(math.exp(-0.5 * math.log(math.sqrt(high / low)) ** 2), abs=1e-9)
    assert q.coverage == on.mean() and (q.perimeter, q.n_components) == (pytest.approx(walked(on)[0]), walked(on)[1])


def test_aspect(spark):
    rows = [(1, [(0, 0, 1)]), (2, [(3, 0, 9)]), (3, [(y, 0, 5) for y in range(5)]), (4, []), (5, [(y, 0, 30) for y in range(10)]), (6, [(y, y, y + 1) for y in range(9)])]
    df = spark.createDataFrame(rows, f"id int, runs {RUNS}")
    got = {r.id: round(r.a, 3) for r in df.select("id", shapes.aspect(F.col("runs")).alias("a")).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.544, 6: 0.0}
    assert df.where("id = 5").select(mk.area(F.col("runs")).alias("n")).first().n == 300


def scored(raw):
    """(valid ratio, mean uncertainty, confidence) by whole windows."""
    valid = np.nan_to_num((raw >= 0.1) & (raw <= 100))
    depth = np.clip(np.nan_to_num(raw, nan=0.1), 0.1, 100)
    win = np.lib.stride_tricks.sliding_window_view(np.pad(depth, 2, mode="symmetric"), (5, 5))
    gy, gx = (np.gradient(depth, axis=a) if depth.shape[a] > 1 else np.zeros_like(depth) for a in (0, 1))
    unc = win.var(axis=(2, 3)) + 0.5 * np.hypot(gx, gy)
    unc = np.where(valid, unc / unc.max() if unc.max() > 1e-9 else unc, 1.0)
    conf = 0.0 if not valid.any() else 0.5 * (1 - unc[valid].mean()) + 0.3 * valid.mean() + 0.2 * (1 - min(1.0, depth[valid].std() / 50))
    return valid.mean(), unc.mean(), conf


def test_depth_of_any_size(spark):
    rng = np.random.default_rng(3)
    smooth = 5 + np.hypot(*np.mgrid[:100, :100]) / 3
    maps = [smooth, np.where(rng.random((100, 100)) < 0.05, 200.0, smooth), rng.uniform(-20, 130, (3, 40)), rng.uniform(0, 9, (40, 3)), rng.uniform(0, 9, (1, 9)), rng.uniform(0, 9, (9, 1)), np.array([[2.0]]), np.full((6, 7), 0.7), np.full((4, 4), 500.0), np.full((4, 4), np.nan)]
    rows = [(k, *m.shape, [float(v) for v in m.ravel()]) for k, m in enumerate(maps)] + [(90, 0, 0, []), (91, 2, 2, None)]
    df = spark.createDataFrame(rows, "id int, height int, width int, depth array<double>")
    got = {r.id: (r.valid_ratio, r.mean_uncertainty, r.confidence) for r in ra.depth_confidence(df).collect()}
    for k, m in enumerate(maps):
        assert got[k] == pytest.approx(scored(m), abs=1e-6), k
    assert got[90] == got[91] == (0.0, 1.0, 0.0)
    plan = ra.depth_confidence(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


def test_weighted_centroid(spark):
    rows = [(1, [(0, 0, 2), (1, 1, 3)], [1.0, 3.0, 9.0, 9.0, 2.0, 4.0]), (2, [], [1.0] * 6), (3, [(0, 0, 2)], [0.0, 0.0] + [1.0] * 4), (4, [(1, 0, 3)], [1.0, 1.0, 1.0, None, 2.0])]
    df = spark.createDataFrame(rows, f"id int, runs {RUNS}, v array<double>")
    got = {r.id: r.c and tuple(r.c) for r in df.select("id", mk.weighted_centroid(F.col("runs"), F.col("v"), 3).alias("c")).collect()}
    assert got == {1: ((3 + 2 + 8) / 10, 0.6), 2: None, 3: None, 4: (1.0, 1.0)}
