"""Service operators on small rows with nulls and ties."""

from pyspark.sql import functions as F

from lumentrack.operators import service as sv


def test_gate(spark):
    rows = spark.createDataFrame([(1, 5, "video/mp4"), (2, 11, "video/mp4"), (3, 5, "text/html"), (4, None, "video/x"), (5, 5, None)], "id int, size long, type string")
    assert {r.id: r.s for r in rows.select("id", sv.gate(F.col("size"), F.col("type"), 10).alias("s")).collect()} == {1: 200, 2: 413, 3: 400, 4: 413, 5: 400}


def test_token_confidence(spark):
    tokens = spark.createDataFrame([(1, [0.0, 0.0]), (1, [1000.0, 0.0]), (2, [])], "text_id int, logits array<double>")
    texts = spark.createDataFrame([(1,), (2,), (3,)], "text_id int")
    assert {r.text_id: round(r.confidence, 6) for r in sv.token_confidence(tokens, texts).collect()} == {1: 0.75, 2: 0.5, 3: 0.5}


def test_scene_and_status(spark):
    objects = spark.createDataFrame([(1, 0, "stationary", 10), (1, 1, "translating", 10), (2, 0, "linear", 4)], "video int, ord int, behaviour string, n_frames int")
    got = {r.video: (r.n_objects, r.dynamic, r.motion, r.complexity) for r in sv.scene(objects, "video").collect()}
    assert got == {1: (2, False, "translational", 0.2), 2: (1, True, "static", 0.04)}
    jobs = spark.createDataFrame([(1, "done", "t"), (2, "queued", None), (3, "done", None)], "job_id int, status string, finished_at string")
    found = {r.job_id: (r.total_objects, r.finished_at, r.download) for r in sv.job_status(jobs, spark.createDataFrame([(1,), (1,), (2,)], "job_id int"), "done").collect()}
    assert found == {1: (2, "t", 200), 2: (None, None, 400), 3: (0, None, 200)}


def test_overlay(spark):
    points = spark.createDataFrame([(1, 0, 2.9, -2.9), (1, 1, None, 1.0)], "obj_id int, pos int, x double, y double")
    assert [tuple(r) for r in sv.overlay(points).collect()] == [(0, 1, 2, -2)]


def test_first_errors(spark):
    """A job's first failing stage is kept beside the results of the others."""
    jobs = spark.createDataFrame([(k,) for k in range(5)], "job_id int")
    rows = lambda *r: spark.createDataFrame(list(r), "job_id int, error string")
    stages = [("source", rows((1, "not found"), (None, "x"))), ("masks", rows((2, "b"), (2, "a"), (1, "later"), (3, None))), ("fusion", rows((2, "later"), (4, "sizes differ")))]
    results = spark.createDataFrame([(0, 7), (1, 8), (4, 9)], "job_id int, n int")
    got = sorted(tuple(r) for r in sv.process(jobs, stages, results).collect())
    assert got == [(0, "success", None, None, 7), (1, "error", "source", "not found", None), (2, "error", "masks", "a", None), (3, "success", None, None, None), (4, "error", "fusion", "sizes differ", None)]


def test_filters_reach_the_scan(spark, tmp_path):
    from lumentrack.operators import fusion as fu

    df = spark.range(10).selectExpr("0 AS video", "cast(id AS string) AS object_id", "struct('l' AS label, id / 10.0D AS confidence, 'm' AS method) AS semantic", "struct(id / 10.0D AS consistency, id AS violations) AS validation")
    df.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    for rows, pushed, n in ((fu.reliable(stored), "GreaterThan(validation.consistency,0.7)", 2), (fu.violating(stored), "GreaterThan(validation.violations,0)", 9), (fu.well_labelled(stored), "GreaterThan(semantic.confidence,0.8)", 1)):
        plan = rows.select("object_id")._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan and "method" not in plan.split("ReadSchema")[1] and rows.count() == n
