"""Trajectory operators on (obj_id, pos, t, x, y, z) rows: windows where state is a neighbour, ordered folds where it is the last corrected row."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "obj_id"
AXES = ("x", "y", "z")
#: Quadratic fit over five points: weights by place in the window (fixed values, over 35).
EDGE0, EDGE1, INNER = (31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3)


def by_pos() -> Window:
    return Window.partitionBy(KEY).orderBy("pos")


def _weighted(c: str, weights, first: int) -> Column:
    w = by_pos()
    return sum(F.lag(c, -(first + k)).over(w) * v for k, v in enumerate(weights)) / 35


def smooth(points: DataFrame) -> DataFrame:
    """Savitzky-Golay (window 5, order 2) per axis and backward velocities; tracks under 5 points stay and have velocity null."""
    n, pos, w = F.col("n"), F.col("pos"), by_pos()
    out = points.withColumn("n", F.count("*").over(Window.partitionBy(KEY)))
    fits = {c: F.when(n < 5, F.col(c)).when(pos == 0, _weighted(c, EDGE0, 0)).when(pos == 1, _weighted(c, EDGE1, -1)).when(pos == n - 2, _weighted(c, EDGE1[::-1], -3)).when(pos == n - 1, _weighted(c, EDGE0[::-1], -4)).otherwise(_weighted(c, INNER, -2)) for c in AXES}
    out = out.withColumns(fits)
    dt = F.col("t") - F.lag("t").over(w)
    return out.withColumns({f"v{c}": F.when(n >= 5, F.when(dt > 0, (F.col(c) - F.lag(c).over(w)) / dt).otherwise(0.0)) for c in AXES}).drop("n")


def summary(points: DataFrame) -> DataFrame:
    """Per track: points, extents, net displacement, duration, path length, mean speed, motion type."""
    w = by_pos()
    step = F.sqrt(sum(F.pow(F.col(c) - F.lag(c).over(w), 2) for c in AXES))
    speed = F.sqrt(sum(F.pow(F.coalesce(F.col(f"v{c}"), F.lit(0.0)), 2) for c in AXES)) if "vx" in points.columns else F.lit(0.0)
    p = points.withColumn("step", step).withColumn("speed", speed)
    ends = [F.max_by(c, "pos") - F.min_by(c, "pos") for c in AXES]
    g = p.groupBy(KEY).agg(
        F.count("*").alias("n_points"), *[f(c).alias(f"{k}_{c}") for c in AXES for k, f in (("min", F.min), ("max", F.max))],
        F.sqrt(sum(F.pow(e, 2) for e in ends)).alias("displacement"), (F.max_by("t", "pos") - F.min_by("t", "pos")).alias("duration"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.avg("speed").alias("mean_speed"),
    )
    linearity = F.col("displacement") / (F.col("path") + 1e-6)
    kind = F.when((F.col("n_points") < 3) | (F.col("displacement") < 0.1), "stationary").when(linearity > 0.9, "linear").when(linearity > 0.5, "parabolic").otherwise("erratic")
    return g.withColumn("motion_type", kind)


def turns(points: DataFrame) -> DataFrame:
    """Sharp turns: rows whose xy step opposes the last one (cosine under -0.5), with the angle in degrees."""
    w = by_pos()
    p = points.select(KEY, "pos", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}2") for c in "xy"], *[(F.lag(c).over(w) - F.lag(c, 2).over(w)).alias(f"{c}1") for c in "xy"])
    a, b = F.sqrt(F.col("x1") ** 2 + F.col("y1") ** 2), F.sqrt(F.col("x2") ** 2 + F.col("y2") ** 2)
    p = p.withColumn("lengths", a * b).where("lengths > 0").withColumn("cos", (F.col("x1") * F.col("x2") + F.col("y1") * F.col("y2")) / F.col("lengths"))
    return p.where("cos < -0.5").select(KEY, "pos", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.col("cos")))).alias("angle"))


def normalise(points: DataFrame, method: str = "minmax") -> DataFrame:
    """``minmax`` (constant axis: 0.5) or ``standardize`` (population deviation; zero: 0); any other method changes nothing."""
    w = Window.partitionBy(KEY)
    if method == "minmax":
        span = {c: F.max(c).over(w) - F.min(c).over(w) for c in AXES}
        return points.withColumns({c: F.when(span[c] > 0, (F.col(c) - F.min(c).over(w)) / span[c]).otherwise(0.5) for c in AXES})
    if method == "standardize":
        return points.withColumns({c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0) for c in AXES})
    return points


def acceleration(points: DataFrame) -> DataFrame:
    """``ax`` of inner rows from vx; absent (null) at the ends and where time stands still."""
    w = by_pos()
    dt = F.lead("t").over(w) - F.lag("t").over(w)
    vx = F.coalesce(F.col("vx"), F.lit(0.0))
    return points.withColumn("ax", F.when(dt != 0, (F.lead(vx).over(w) - vx) / dt))


def temporal_consistency(points: DataFrame, score: str, window: int = 5) -> DataFrame:
    """Per track: 1 - min(1, 2 * population variance of complete rolling means); 1 under ``window`` points."""
    rolling = F.avg(F.coalesce(F.col(score), F.lit(1.0))).over(by_pos().rowsBetween(1 - window, 0))
    p = points.withColumn("mean", F.when(F.row_number().over(by_pos()) >= window, rolling))
    return p.groupBy(KEY).agg(F.coalesce(1 - F.least(F.lit(1.0), 2 * F.var_pop("mean")), F.lit(1.0)).alias("temporal_consistency"))


def validity(points: DataFrame) -> DataFrame:
    """Per track: (valid, message of the first failing point): missing field, NaN or infinite, time going back."""
    bad = [F.isnan(c) | (F.abs(c) == float("inf")) for c in map(F.col, AXES)]
    message = F.when(F.greatest(*[F.col(c).isNull() for c in (*AXES, "t")]), "missing field").when(bad[0] | bad[1] | bad[2], "not a number").when(F.col("t") < F.lag("t").over(by_pos()), "time goes back")
    p = points.withColumn("message", message)
    return p.groupBy(KEY).agg((F.count("message") == 0).alias("valid"), F.coalesce(F.min_by("message", F.when(F.col("message").isNotNull(), F.col("pos"))), F.lit("ok")).alias("message"))


def interpolate(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Points at the target frames ``pos``: those that exist, else linear between the nearest neighbours, else none."""
    fields = ("t", *AXES)
    known = points.select(KEY, "pos", F.struct("pos", *fields).alias("own"))
    every = known.join(targets.select(KEY, "pos", F.lit(True).alias("wanted")), [KEY, "pos"], "full")
    w = by_pos()
    around = every.select(KEY, "pos", "own", "wanted", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.first("own", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    share = (F.col("pos") - F.col("a.pos")) / (F.col("b.pos") - F.col("a.pos"))
    mixed = [F.when(F.col("own").isNotNull(), F.col(f"own.{c}")).otherwise(F.col(f"a.{c}") + F.when(F.col("own").isNull(), share) * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in fields]
    return around.where("wanted AND a IS NOT NULL AND b IS NOT NULL").select(KEY, "pos", *mixed, F.col("own").isNull().alias("interpolated"))


def gravity_fit(points: DataFrame) -> DataFrame:
    """Per track: R2 of a quadratic z over scaled time, from normal equations; 1 under three points, 0.5 where no fit exists."""
    w = Window.partitionBy(KEY)
    first, last = F.min_by("t", "pos").over(w), F.max_by("t", "pos").over(w)
    p = points.withColumn("s", (F.col("t") - first) / (last - first + 1e-6)).withColumn("zc", F.col("z") - F.avg("z").over(w))
    sums = p.groupBy(KEY).agg(F.count("*").alias("n"), *[F.sum(F.pow("s", F.lit(k))).alias(f"s{k}") for k in range(1, 5)], *[F.sum(F.col("zc") * F.pow("s", F.lit(k))).alias(f"b{k}") for k in range(3)], F.sum(F.col("zc") ** 2).alias("total"))
    m = [[F.col("n").cast("double"), F.col("s1"), F.col("s2")], [F.col("s1"), F.col("s2"), F.col("s3")], [F.col("s2"), F.col("s3"), F.col("s4")]]
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    b = [F.col(f"b{k}") for k in range(3)]
    swapped = [[[b[r] if c == k else m[r][c] for c in range(3)] for r in range(3)] for k in range(3)]
    explained = sum(F.try_divide(det(swapped[k]), det(m)) * b[k] for k in range(3))
    r2 = 1 - (F.col("total") - explained) / (F.col("total") + 1e-6)
    fit = F.when(F.col("n") < 3, 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)), F.lit(0.5)))
    return sums.select(KEY, fit.alias("conformance"))


def fold(points: DataFrame, step, schema: str) -> DataFrame:
    """Ordered fold of each track: ``step(state, row)`` gives (state, output row), the state of a track's first row being None.

    A track's rows are sorted by Spark and stream through one task, which holds a batch and the
    state, whatever the track's length; tracks come one after another. ``points`` needs obj_id and pos.
    """
    rows = points.repartition(KEY).sortWithinPartitions(KEY, "pos")
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        track, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.obj_id != track:
                    track, state = row.obj_id, None
                state, found = step(state, row)
                out.append(found)
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def speed_step(last, row, here, max_speed: float, midpoint: bool = False):
    """(x, y, z) of a row against the last output (t, x, y, z), or None before: (point, whether it was moved, speed where it was)."""
    if last is None:
        return here, False, None
    dt = row.t - last[0] if row.t > last[0] else 0.033
    gap = math.dist(last[1:], here)
    if not gap / dt > max_speed:
        return here, False, None
    share = 0.5 if midpoint else max_speed * dt / gap
    return tuple(a + (b - a) * share for a, b in zip(last[1:], here, strict=True)), True, gap / dt


def acceleration_step(before, last, row, here, max_acceleration: float):
    """As ``speed_step`` for the acceleration from the last two outputs; points pass while there are fewer, and where time stands still."""
    if before is None or last is None or not (last[0] > before[0] and row.t > last[0]):
        return here, False, None
    dt = row.t - last[0]
    v = [(b - a) / (last[0] - before[0]) for a, b in zip(before[1:], last[1:], strict=True)]
    acc = [((b - a) / dt - w) / dt for a, b, w in zip(last[1:], here, v, strict=True)]
    size = math.hypot(*acc)
    if not size > max_acceleration:
        return here, False, None
    return tuple(a + (w + k * max_acceleration / size * dt) * dt for a, w, k in zip(last[1:], v, acc, strict=True)), True, size


_CLAMPED = "pos int, t double, x double, y double, z double, hit boolean, measure double"


def _clamp(points: DataFrame, step) -> DataFrame:
    rows = points.select(KEY, F.col("pos").cast("int").alias("pos"), "t", *AXES)
    return fold(rows, step, f"{KEY} {points.schema[KEY].dataType.simpleString()}, {_CLAMPED}")


def clamp_speed(points: DataFrame, max_speed: float, midpoint: bool = False) -> DataFrame:
    """Points whose speed from the last output exceeds ``max_speed`` move to where it is met (or, ``midpoint``, halfway); hit marks them, measure is the speed."""

    def step(last, row):
        here, hit, speed = speed_step(last, row, (row.x, row.y, row.z), max_speed, midpoint)
        return (row.t, *here), (row.obj_id, row.pos, row.t, *here, hit, speed)

    return _clamp(points, step)


def clamp_acceleration(points: DataFrame, max_acceleration: float) -> DataFrame:
    """As ``clamp_speed`` for the acceleration from the last two outputs; the first two points pass, and points where time stands still."""

    def step(state, row):
        before, last = state or (None, None)
        here, hit, size = acceleration_step(before, last, row, (row.x, row.y, row.z), max_acceleration)
        return (last, (row.t, *here)), (row.obj_id, row.pos, row.t, *here, hit, size)

    return _clamp(points, step)
