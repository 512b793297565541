"""Trajectory queries over tracks of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrack.operators import physics as ph
from lumentrack.operators import trajectory as tj
from lumentrack.sources.adapters import SQL, r6, tracks
from lumentrack.sources.tables import table

MAX_SPEED, MAX_ACCELERATION = 0.02, 0.00001


def _tracks(spark, d):
    return tracks(table(spark, d, "events"))


def _round(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def track_smooth(spark, d):
    return _round(tj.smooth(_tracks(spark, d)).select("obj_id", "pos", *tj.AXES, "vx", "vy", "vz"), *tj.AXES, "vx", "vy", "vz")


def track_summary(spark, d):
    s = tj.summary(tj.smooth(_tracks(spark, d)))
    return _round(s, "displacement", "duration", "path", "mean_speed", *[f"{k}_{c}" for c in tj.AXES for k in ("min", "max")])


def track_turns(spark, d):
    return _round(tj.turns(_tracks(spark, d)), "angle")


def track_minmax(spark, d):
    return _round(tj.normalise(_tracks(spark, d)).select("obj_id", "pos", *tj.AXES), *tj.AXES)


def track_standardize(spark, d):
    return _round(tj.normalise(_tracks(spark, d), "standardize").select("obj_id", "pos", *tj.AXES), *tj.AXES)


def track_acceleration(spark, d):
    return _round(tj.acceleration(tj.smooth(_tracks(spark, d))).select("obj_id", "pos", (F.col("ax") * 1e6).alias("ax_scaled")), "ax_scaled")


def track_temporal_consistency(spark, d):
    p = _tracks(spark, d).withColumn("score", F.col("y") / 100)
    return _round(tj.temporal_consistency(p, "score"), "temporal_consistency")


def track_validity(spark, d):
    p = _tracks(spark, d).withColumn("x", F.when((F.col("obj_id") % 5 == 0) & (F.col("pos") == 7), F.lit(None)).otherwise(F.col("x")))
    return tj.validity(p.withColumn("t", F.when((F.col("obj_id") % 7 == 1) & (F.col("pos") == 3), 0.0).otherwise(F.col("t"))))


def track_interpolate(spark, d):
    p = _tracks(spark, d)
    targets = p.groupBy("obj_id").agg(F.max("pos").alias("m")).select("obj_id", F.explode(F.sequence(F.lit(0), F.col("m") * 3 + 3)).alias("pos"))
    return _round(tj.interpolate(p.withColumn("pos", F.col("pos") * 3), targets), *tj.AXES).withColumn("t", F.round("t", 3))


def track_gravity(spark, d):
    return tj.gravity_fit(_tracks(spark, d)).withColumn("conformance", F.round("conformance", 4) + 0.0)


def _clamped(df):
    return _round(df.select("obj_id", "pos", *tj.AXES, "hit", "measure"), *tj.AXES, "measure")


def track_clamp_speed(spark, d):
    return _clamped(tj.clamp_speed(_tracks(spark, d), MAX_SPEED))


def track_clamp_midpoint(spark, d):
    return _clamped(tj.clamp_speed(_tracks(spark, d), MAX_SPEED, midpoint=True))


def track_clamp_acceleration(spark, d):
    return _clamped(tj.clamp_acceleration(_tracks(spark, d), MAX_ACCELERATION).withColumn("measure", F.col("measure") * 1e3))


def _classes(tracks):
    """A class for each track (obj_id, any number of times) by its number; the last has no limits of its own."""
    names = F.array(*[F.lit(x) for x in ("Human", "robot", "ball", "drone", "vehicle", "cloud")])
    return tracks.select("obj_id").distinct().select("obj_id", F.get(names, (F.col("obj_id") % 6).cast("int")).alias("object_class"))


def physics_report(spark, d):
    """Violations of each track by type under the limits of its class; time runs a hundred thousand times as fast, so that the limits matter."""
    points = _tracks(spark, d).withColumn("t", F.col("t") / 1e5)
    return ph.report(points, _classes(table(spark, d, "events").select(F.col("user_id").alias("obj_id"))), ph.limits(spark))


QUERIES = {f.__name__: f for f in (track_smooth, track_summary, track_turns, track_minmax, track_standardize, track_acceleration, track_temporal_consistency, track_validity, track_interpolate, track_gravity, track_clamp_speed, track_clamp_midpoint, track_clamp_acceleration, physics_report)}

_W = "OVER (PARTITION BY obj_id ORDER BY pos)"


def _sg(c):
    at = lambda k: f"lead({c}, {k}) {_W}" if k > 0 else f"lag({c}, {-k}) {_W}" if k < 0 else c
    fit = lambda ws, first: "(" + " + ".join(f"({w}) * {at(first + k)}" for k, w in enumerate(ws)) + ") / 35"
    return f"CASE WHEN n < 5 THEN {c} WHEN pos = 0 THEN {fit((31, 9, -3, -5, 3), 0)} WHEN pos = 1 THEN {fit((9, 13, 12, 6, -5), -1)} WHEN pos = n - 2 THEN {fit((-5, 6, 12, 13, 9), -3)} WHEN pos = n - 1 THEN {fit((3, -5, -3, 9, 31), -4)} ELSE {fit((-3, 12, 17, 12, -3), -2)} END AS {c}"


def smooth_sql(source: str, *more: str) -> str:
    """CTEs up to sm: ``source`` (obj_id, pos, t, x, y, z and ``more``) smoothed, with velocities."""
    keep = "".join(f", {c}" for c in more)
    speeds = ", ".join(f"CASE WHEN n >= 5 THEN CASE WHEN t - lag(t) {_W} > 0 THEN ({c} - lag({c}) {_W}) / (t - lag(t) {_W}) ELSE 0.0 END END AS v{c}" for c in "xyz")
    return f"cn AS (SELECT *, count(*) OVER (PARTITION BY obj_id) AS n FROM {source}), sg AS (SELECT obj_id, pos, t, n{keep}, {', '.join(_sg(c) for c in 'xyz')} FROM cn), sm AS (SELECT *, {speeds} FROM sg)"


_SM = f"{SQL['tr']}, {smooth_sql('tr')}"
_STEP = "sqrt(power(x - lag(x) {w}, 2) + power(y - lag(y) {w}, 2) + power(z - lag(z) {w}, 2))".format(w=_W)
#: Unrounded rows of track_summary, as su.
SUMMARY_CTE = f"""{_SM}, st AS (SELECT *, {_STEP} AS step, sqrt(power(coalesce(vx, 0), 2) + power(coalesce(vy, 0), 2) + power(coalesce(vz, 0), 2)) AS speed FROM sm),
g AS (SELECT obj_id, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, sqrt(power(arg_max(x, pos) - arg_min(x, pos), 2) + power(arg_max(y, pos) - arg_min(y, pos), 2) + power(arg_max(z, pos) - arg_min(z, pos), 2)) AS displacement, arg_max(t, pos) - arg_min(t, pos) AS duration, coalesce(sum(step), 0) AS path, avg(speed) AS mean_speed FROM st GROUP BY obj_id),
su AS (SELECT *, CASE WHEN n_points < 3 OR displacement < 0.1 THEN 'stationary' WHEN displacement / (path + 1e-6) > 0.9 THEN 'linear' WHEN displacement / (path + 1e-6) > 0.5 THEN 'parabolic' ELSE 'erratic' END AS motion_type FROM g)"""


def _speed_sql(share: str, bound: float = MAX_SPEED) -> str:
    gap = "sqrt(power(c.x - r.x, 2) + power(c.y - r.y, 2) + power(c.z - r.z, 2))"
    return f"""r(obj_id, pos, t, x, y, z, hit, measure) AS (SELECT obj_id, pos, t, x, y, z, false, NULL::DOUBLE FROM tr WHERE pos = 0
  UNION ALL SELECT obj_id, pos, t, CASE WHEN s > {bound} THEN rx + (x - rx) * {share} ELSE x END, CASE WHEN s > {bound} THEN ry + (y - ry) * {share} ELSE y END, CASE WHEN s > {bound} THEN rz + (z - rz) * {share} ELSE z END, s > {bound}, CASE WHEN s > {bound} THEN s END
  FROM (SELECT c.*, r.x AS rx, r.y AS ry, r.z AS rz, {gap} AS gap, CASE WHEN c.t - r.t > 0 THEN c.t - r.t ELSE 0.033::DOUBLE END AS dt, {gap} / (CASE WHEN c.t - r.t > 0 THEN c.t - r.t ELSE 0.033::DOUBLE END) AS s FROM r JOIN tr c ON c.obj_id = r.obj_id AND c.pos = r.pos + 1) q)"""


def _acc_sql(src: str) -> str:
    a = MAX_ACCELERATION
    return f"""q(obj_id, pos, t, x, y, z, t0, x0, y0, z0, hit, measure) AS (SELECT obj_id, pos, t, x, y, z, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false, NULL::DOUBLE FROM {src} WHERE pos = 0
  UNION ALL SELECT obj_id, pos, t, CASE WHEN hit THEN x1 + (vx + ax * {a} / m * t2) * t2 ELSE x END, CASE WHEN hit THEN y1 + (vy + ay * {a} / m * t2) * t2 ELSE y END, CASE WHEN hit THEN z1 + (vz + az * {a} / m * t2) * t2 ELSE z END, t1a, x1, y1, z1, hit, CASE WHEN hit THEN m END FROM (
  SELECT *, coalesce(m > {a}, false) AS hit FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS m FROM (SELECT *, ((x - x1) / t2 - vx) / t2 AS ax, ((y - y1) / t2 - vy) / t2 AS ay, ((z - z1) / t2 - vz) / t2 AS az FROM (
  SELECT c.*, p.t AS t1a, p.x AS x1, p.y AS y1, p.z AS z1, CASE WHEN p.t - p.t0 > 0 AND c.t - p.t > 0 THEN c.t - p.t END AS t2, (p.x - p.x0) / CASE WHEN p.t - p.t0 > 0 AND c.t - p.t > 0 THEN p.t - p.t0 END AS vx, (p.y - p.y0) / CASE WHEN p.t - p.t0 > 0 AND c.t - p.t > 0 THEN p.t - p.t0 END AS vy, (p.z - p.z0) / CASE WHEN p.t - p.t0 > 0 AND c.t - p.t > 0 THEN p.t - p.t0 END AS vz
  FROM q p JOIN (SELECT obj_id, pos, t, x, y, z FROM {src}) c ON c.obj_id = p.obj_id AND c.pos = p.pos + 1) a1) a2) a3) a4)"""


ORACLE_SQL = {
    "track_smooth": f"WITH {_SM} SELECT obj_id, pos, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))} FROM sm",
    "track_summary": f"""WITH {SUMMARY_CTE}
SELECT obj_id, n_points, {', '.join(f'round({k}_{c}, 6) + 0.0 AS {k}_{c}' for c in 'xyz' for k in ('min', 'max'))}, round(displacement, 6) AS displacement, round(duration, 6) AS duration, round(path, 6) AS path, round(mean_speed, 6) AS mean_speed, motion_type FROM su""",
    "track_turns": f"""WITH {SQL['tr']}, s AS (SELECT obj_id, pos, x - lag(x) {_W} AS x2, y - lag(y) {_W} AS y2, lag(x) {_W} - lag(x, 2) {_W} AS x1, lag(y) {_W} - lag(y, 2) {_W} AS y1 FROM tr),
c AS (SELECT obj_id, pos, (x1 * x2 + y1 * y2) / (sqrt(x1 * x1 + y1 * y1) * sqrt(x2 * x2 + y2 * y2)) AS c FROM s WHERE sqrt(x1 * x1 + y1 * y1) * sqrt(x2 * x2 + y2 * y2) > 0) SELECT obj_id, pos, round(degrees(acos(greatest(-1.0, c))), 6) AS angle FROM c WHERE c < -0.5""",
    "track_minmax": f"WITH {SQL['tr']}, m AS (SELECT obj_id, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in 'xyz')} FROM tr GROUP BY obj_id) SELECT obj_id, pos, {', '.join(f'round(CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.5 END, 6) AS {c}' for c in 'xyz')} FROM tr JOIN m USING (obj_id)",
    "track_standardize": f"WITH {SQL['tr']}, m AS (SELECT obj_id, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in 'xyz')} FROM tr GROUP BY obj_id) SELECT obj_id, pos, {', '.join(f'round(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END, 6) + 0.0 AS {c}' for c in 'xyz')} FROM tr JOIN m USING (obj_id)",
    "track_acceleration": f"WITH {_SM}, w AS (SELECT obj_id, pos, t, coalesce(vx, 0) AS vx FROM sm) SELECT obj_id, pos, round(CASE WHEN lead(t) {_W} - lag(t) {_W} <> 0 THEN (lead(vx) {_W} - vx) / (lead(t) {_W} - lag(t) {_W}) END * 1e6, 6) + 0.0 AS ax_scaled FROM w",
    "track_temporal_consistency": f"WITH {SQL['tr']}, m AS (SELECT obj_id, pos, CASE WHEN pos >= 4 THEN avg(y / 100) OVER (PARTITION BY obj_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS m FROM tr) SELECT obj_id, round(coalesce(1 - least(1.0, 2 * var_pop(m)), 1.0), 6) AS temporal_consistency FROM m GROUP BY obj_id",
    "track_validity": f"""WITH {SQL['tr']}, p AS (SELECT obj_id, pos, CASE WHEN obj_id % 5 = 0 AND pos = 7 THEN NULL ELSE x END AS x, y, z, CASE WHEN obj_id % 7 = 1 AND pos = 3 THEN 0.0 ELSE t END AS t FROM tr),
m AS (SELECT obj_id, pos, CASE WHEN x IS NULL OR y IS NULL OR z IS NULL OR t IS NULL THEN 'missing field' WHEN t < lag(t) {_W} THEN 'time goes back' END AS m FROM p)
SELECT obj_id, count(m) = 0 AS valid, coalesce(arg_min(m, pos) FILTER (m IS NOT NULL), 'ok') AS message FROM m GROUP BY obj_id""",
    "track_interpolate": f"""WITH {SQL['tr']}, k AS (SELECT obj_id, pos * 3 AS pos, t, x, y, z, lead(t) {_W} AS t2, lead(x) {_W} AS x2, lead(y) {_W} AS y2, lead(z) {_W} AS z2 FROM tr)
SELECT obj_id, pos + j AS pos, {', '.join(f'round(CASE WHEN j = 0 THEN {c} ELSE {c} + j / 3 * ({c}2 - {c}) END, {3 if c == "t" else 6}) + 0.0 AS {c}' for c in 'txyz')}, j > 0 AS interpolated FROM k, (SELECT unnest([0, 1, 2]) AS j) WHERE j = 0 OR t2 IS NOT NULL""",
    "track_gravity": f"""WITH {SQL['tr']}, p AS (SELECT obj_id, z - avg(z) OVER (PARTITION BY obj_id) AS z, (t - min(t) OVER (PARTITION BY obj_id)) / (max(t) OVER (PARTITION BY obj_id) - min(t) OVER (PARTITION BY obj_id) + 1e-6) AS s FROM tr),
g AS (SELECT obj_id, count(*)::DOUBLE AS n, sum(s) AS s1, sum(s * s) AS s2, sum(s * s * s) AS s3, sum(s * s * s * s) AS s4, sum(z) AS b0, sum(z * s) AS b1, sum(z * s * s) AS b2, sum(z * z) AS tot FROM p GROUP BY obj_id),
d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det, b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2) AS d0, n * (b1 * s4 - s3 * b2) - b0 * (s1 * s4 - s3 * s2) + s2 * (s1 * b2 - b1 * s2) AS d1, n * (s2 * b2 - b1 * s3) - s1 * (s1 * b2 - b1 * s2) + b0 * (s1 * s3 - s2 * s2) AS d2 FROM g)
SELECT obj_id, round(CASE WHEN n < 3 THEN 1.0 WHEN det = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - (tot - (d0 * b0 + d1 * b1 + d2 * b2) / det) / (tot + 1e-6))) END, 4) AS conformance FROM d""",
    "track_clamp_speed": f"WITH RECURSIVE {SQL['tr']}, {_speed_sql(f'({MAX_SPEED} * dt / gap)')} SELECT obj_id, pos, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, hit, round(measure, 6) AS measure FROM r",
    "track_clamp_midpoint": f"WITH RECURSIVE {SQL['tr']}, {_speed_sql('0.5')} SELECT obj_id, pos, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, hit, round(measure, 6) AS measure FROM r",
    "track_clamp_acceleration": f"WITH RECURSIVE {SQL['tr']}, {_acc_sql('tr')} SELECT obj_id, pos, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, hit, round(measure * 1e3, 6) AS measure FROM q",
    "physics_report": f"""WITH RECURSIVE {SQL['tr']},
lim(class, ms, ma, grav) AS (VALUES ('human', 10.0::DOUBLE, 10.0::DOUBLE, true), ('robot', 5.0, 5.0, false), ('ball', 30.0, 100.0, true), ('drone', 15.0, 10.0, false), ('vehicle', 50.0, 5.0, false), ('unknown', 20.0, 20.0, false)),
cl AS (SELECT DISTINCT obj_id, ['Human', 'robot', 'ball', 'drone', 'vehicle', 'cloud'][obj_id % 6 + 1] AS object_class FROM tr),
pt AS (SELECT tr.obj_id, pos, t / 1e5 AS t, x * 0.01 AS x, y * 0.01 AS y, z, ms, ma FROM tr JOIN cl USING (obj_id) JOIN lim ON lim.class = CASE WHEN lower(object_class) = 'cloud' THEN 'unknown' ELSE lower(object_class) END),
sp AS (SELECT obj_id, pos, t, x, y, z, ma, false AS hit FROM pt WHERE pos = 0
  UNION ALL SELECT obj_id, pos, t, CASE WHEN gap / dt > ms THEN rx + (x - rx) * ms * dt / gap ELSE x END, CASE WHEN gap / dt > ms THEN ry + (y - ry) * ms * dt / gap ELSE y END, CASE WHEN gap / dt > ms THEN rz + (z - rz) * ms * dt / gap ELSE z END, ma, gap / dt > ms
  FROM (SELECT c.*, r.x AS rx, r.y AS ry, r.z AS rz, sqrt((c.x - r.x) ** 2 + (c.y - r.y) ** 2 + (c.z - r.z) ** 2) AS gap, CASE WHEN c.t > r.t THEN c.t - r.t ELSE 0.033::DOUBLE END AS dt FROM sp r JOIN pt c ON c.obj_id = r.obj_id AND c.pos = r.pos + 1) g),
ac AS (SELECT obj_id, pos, t, x, y, z, NULL::DOUBLE AS t0, NULL::DOUBLE AS x0, NULL::DOUBLE AS y0, NULL::DOUBLE AS z0, false AS hit FROM sp WHERE pos = 0
  UNION ALL SELECT obj_id, pos, t, CASE WHEN m > ma THEN px + (vx + ax * ma / m * d2) * d2 ELSE x END, CASE WHEN m > ma THEN py + (vy + ay * ma / m * d2) * d2 ELSE y END, CASE WHEN m > ma THEN pz + (vz + az * ma / m * d2) * d2 ELSE z END, pt, px, py, pz, coalesce(m > ma, false)
  FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS m FROM (SELECT *, ((x - px) / d2 - vx) / d2 AS ax, ((y - py) / d2 - vy) / d2 AS ay, ((z - pz) / d2 - vz) / d2 AS az
    FROM (SELECT c.obj_id, c.pos, c.t, c.x, c.y, c.z, c.ma, p.t AS pt, p.x AS px, p.y AS py, p.z AS pz, CASE WHEN p.t > p.t0 AND c.t > p.t THEN c.t - p.t END AS d2, (p.x - p.x0) / CASE WHEN p.t > p.t0 THEN p.t - p.t0 END AS vx, (p.y - p.y0) / CASE WHEN p.t > p.t0 THEN p.t - p.t0 END AS vy, (p.z - p.z0) / CASE WHEN p.t > p.t0 THEN p.t - p.t0 END AS vz
      FROM ac p JOIN sp c ON c.obj_id = p.obj_id AND c.pos = p.pos + 1) a1) a2) a3),
tu AS (SELECT obj_id, count(*) FILTER (la > 0 AND lb > 0 AND dot / (la * lb) < -0.5) AS n FROM (SELECT obj_id, sqrt(ux * ux + uy * uy) AS la, sqrt(wx * wx + wy * wy) AS lb, ux * wx + uy * wy AS dot
  FROM (SELECT obj_id, lag(x) {_W} - lag(x, 2) {_W} AS ux, lag(y) {_W} - lag(y, 2) {_W} AS uy, x - lag(x) {_W} AS wx, y - lag(y) {_W} AS wy FROM ac) a) b GROUP BY obj_id),
gp AS (SELECT obj_id, z - avg(z) OVER (PARTITION BY obj_id) AS z, (t - first_value(t) {_W}) / (max(t) OVER (PARTITION BY obj_id) - min(t) OVER (PARTITION BY obj_id) + 1e-6) AS s FROM ac),
gs AS (SELECT obj_id, count(*)::DOUBLE AS n, sum(s) AS s1, sum(s ** 2) AS s2, sum(s ** 3) AS s3, sum(s ** 4) AS s4, sum(z) AS b0, sum(z * s) AS b1, sum(z * s * s) AS b2, sum(z * z) AS tot FROM gp GROUP BY obj_id),
gf AS (SELECT obj_id, n, CASE WHEN n < 3 THEN 1.0 WHEN det = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - (tot - (d0 * b0 + d1 * b1 + d2 * b2) / det) / (tot + 1e-6))) END AS fit
  FROM (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det, b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2) AS d0, n * (b1 * s4 - s3 * b2) - b0 * (s1 * s4 - s3 * s2) + s2 * (s1 * b2 - b1 * s2) AS d1, n * (s2 * b2 - b1 * s3) - s1 * (s1 * b2 - b1 * s2) + b0 * (s1 * s3 - s2 * s2) AS d2 FROM gs) d),
v AS (SELECT cl.obj_id, object_class, gf.n AS n, (SELECT count(*) FROM sp WHERE sp.obj_id = cl.obj_id AND hit) AS n_speed, (SELECT count(*) FROM ac WHERE ac.obj_id = cl.obj_id AND hit) AS n_acceleration, CASE WHEN object_class IN ('Human', 'ball') AND fit < 0.5 THEN 1 ELSE 0 END::BIGINT AS n_gravity, tu.n AS n_turn
  FROM cl JOIN gf ON gf.obj_id = cl.obj_id JOIN tu ON tu.obj_id = cl.obj_id)
SELECT obj_id, object_class, n_speed, n_acceleration, 0::BIGINT AS n_jerk, n_gravity, n_turn AS n_direction_change, n_speed + n_acceleration + n_gravity + n_turn AS total_violations, n_speed + n_acceleration AS frames_corrected,
  CASE WHEN n < 2 THEN 'too_short' WHEN n_speed + n_acceleration + n_gravity + n_turn = 0 THEN 'valid' ELSE 'invalid' END AS status FROM (SELECT v.* FROM v) q""",
}
