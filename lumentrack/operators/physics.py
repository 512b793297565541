"""Physics checks of tracks by object class: clamps, gravity, sharp turns, and a report of violations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrack.operators import trajectory as tj
from lumentrack.sources.store import stored

#: Limits by class (fixed values): speed, acceleration, jerk, needs gravity, may reverse at once, least contact in seconds.
LIMITS = (
    ("human", 10.0, 10.0, 50.0, True, False, 0.1), ("robot", 5.0, 5.0, 20.0, False, False, 0.0), ("ball", 30.0, 100.0, 500.0, True, False, 0.05),
    ("drone", 15.0, 10.0, 30.0, False, False, 0.0), ("vehicle", 50.0, 5.0, 10.0, False, False, 0.0), ("unknown", 20.0, 20.0, 100.0, False, False, 0.0),
)
PIXEL_TO_METRE = 0.01


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "class string, max_speed double, max_acceleration double, max_jerk double, requires_gravity boolean, can_reverse_instantly boolean, min_contact_duration double")


def with_limits(classes: DataFrame, table: DataFrame) -> DataFrame:
    """(obj_id, object_class) with its class's limits, in any case of letters; those of ``unknown`` where it has none. ``table`` has a row a class; Spark broadcasts it if it is small."""
    named = classes.join(table, F.lower("object_class") == F.col("class"), "left")
    default = table.where("class = 'unknown'").select(F.struct(*[c for c in table.columns if c != "class"]).alias("d"))
    pick = [F.coalesce(F.col(c), F.col(f"d.{c}")).alias(c) for c in table.columns if c != "class"]
    return named.crossJoin(F.broadcast(default)).select("obj_id", "object_class", *pick)  # one row of defaults


def metres(points: DataFrame, scale: float = PIXEL_TO_METRE) -> DataFrame:
    """x, y and, where there are such columns, vx, vy from pixels to metres; depth and its speed are in metres already. Back with ``1 / scale``."""
    return points.withColumns({c: F.col(c) * scale for c in ("x", "y", "vx", "vy") if c in points.columns})


def clamp(points: DataFrame) -> DataFrame:
    """Points with max_speed and max_acceleration of their track -> both clamps and the turn check in one pass.

    (obj_id, pos, t, x, y, z, fast, hard, turned): the speed clamp works on its own last output, the
    acceleration clamp on that of the first, and a turn of more than 120 degrees in x and y is
    looked for in what comes out.
    """

    def step(state, row):
        slow, outs = state or (None, ())
        here, fast, _ = tj.speed_step(slow, row, (row.x, row.y, row.z), row.max_speed)
        slow = (row.t, *here)
        before, last = (None, *outs)[-2:] if outs else (None, None)
        here, hard, _ = tj.acceleration_step(before, last, row, here, row.max_acceleration)
        turned = False
        if before is not None:
            a, b = (last[1] - before[1], last[2] - before[2]), (here[0] - last[1], here[1] - last[2])
            lengths = math.hypot(*a) * math.hypot(*b)
            turned = lengths > 0 and (a[0] * b[0] + a[1] * b[1]) / lengths < -0.5
        return (slow, (*outs, (row.t, *here))[-2:]), (row.obj_id, row.pos, row.t, *here, fast, hard, turned)

    schema = f"obj_id {points.schema['obj_id'].dataType.simpleString()}, pos int, t double, x double, y double, z double, fast boolean, hard boolean, turned boolean"
    rows = points.select("obj_id", F.col("pos").cast("int").alias("pos"), "t", *tj.AXES, "max_speed", "max_acceleration")
    return tj.fold(rows, step, schema)


def report(points: DataFrame, classes: DataFrame, table: DataFrame, units: str = "pixels") -> DataFrame:
    """Per track: object_class, violations by type, their total, frames_corrected, status (too_short, valid or invalid).

    (obj_id, object_class) names a track's class, whose limits apply. Gravity counts one violation where the class needs it
    and a parabola explains less than half of z; turns count unless the class may
    reverse at once; the jerk check finds nothing, as in the rules this follows.
    """
    own = with_limits(classes, table)
    moved = metres(points) if units == "pixels" else points
    clamped = stored(clamp(moved.join(own.select("obj_id", "max_speed", "max_acceleration"), "obj_id")), "clamped")  # the fold runs once for both sums
    count = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    sums = clamped.groupBy("obj_id").agg(F.count("*").alias("n_points"), count("fast"), count("hard"), count("turned"))
    fall = tj.gravity_fit(clamped.join(own.where("requires_gravity").select("obj_id"), "obj_id", "left_semi"))
    j = sums.join(own, "obj_id").join(fall, "obj_id", "left")
    short = F.col("n_points") < 2
    zero = F.lit(0).cast("long")
    kinds = {
        "n_speed": F.col("n_fast"), "n_acceleration": F.col("n_hard"), "n_jerk": zero,
        "n_gravity": F.when(F.col("requires_gravity") & (F.col("conformance") < 0.5), 1).otherwise(0).cast("long"),
        "n_direction_change": F.when(F.col("can_reverse_instantly"), zero).otherwise(F.col("n_turned")),
    }
    out = j.select("obj_id", "object_class", short.alias("short"), *[F.when(short, zero).otherwise(v).alias(k) for k, v in kinds.items()])
    total = sum(F.col(k) for k in kinds)
    status = F.when(F.col("short"), "too_short").when(total == 0, "valid").otherwise("invalid")
    return out.select("obj_id", "object_class", *kinds, total.alias("total_violations"), (F.col("n_speed") + F.col("n_acceleration") + F.col("n_jerk")).alias("frames_corrected"), status.alias("status"))
