"""Files that land over time, and documents that are written more than once."""

import json

import pytest

from lumentrack.streaming import landing, sink
from lumentrack.streaming.tables import read


def test_three_triggers(spark, tmp_path):
    """Each file is seen once; those too large or of another type are refused and stay unread."""
    box, home = tmp_path / "box", str(tmp_path / "home")
    box.mkdir()
    stream = lambda: landing.uploads(spark, str(box), most=100, files=2)
    for names in ({"a.mp4": 10, "b.MOV": 100, "c.avi": 101}, {"d.txt": 5, "e": 5}, {"f.mp4": 1, "g.mp4": 1000, "empty.mp4": 0}, {}):
        for name, size in names.items():
            (box / name).write_bytes(b"x" * size)
        landing.land(stream(), home)
    ok, bad = landing.landed(spark, home)
    short = lambda p: p.rsplit("/", 1)[1]
    assert sorted((short(r.path), r.size) for r in ok.collect()) == [("a.mp4", 10), ("b.MOV", 100), ("f.mp4", 1)]
    assert sorted((short(r.path), r.status, r.error) for r in bad.collect()) == [("c.avi", 413, "larger than 100 bytes"), ("d.txt", 400, "not a video"), ("e", 400, "not a video"), ("g.mp4", 413, "larger than 100 bytes")]
    found = landing.contents(spark, str(box), ok)
    assert sorted((short(r.path), len(r.content)) for r in found.collect()) == [("a.mp4", 10), ("b.MOV", 100), ("f.mp4", 1)]
    assert "LessThanOrEqual(length,100)" in found._jdf.queryExecution().executedPlan().toString()


def test_sink_is_idempotent(spark, tmp_path):
    schema = "job_id string, object_id string, document string"
    one = spark.createDataFrame([("j1", "a", "{}"), ("j2", "b", '{"x": "ü"}'), ("j1", "c", None)], schema)
    two = spark.createDataFrame([("j1", "d", "[1]")], schema)
    folder = str(tmp_path / "docs")
    listed = lambda: sorted((r.job_id, r.object_id, r.document) for r in sink.read_documents(spark, folder).fillna("-").collect())
    for _ in range(2):
        sink.write_batch(one, 0, folder)
        sink.write_batch(two, 1, folder)
    assert listed() == [("j1", "a", "{}"), ("j1", "c", "-"), ("j1", "d", "[1]"), ("j2", "b", '{"x": "ü"}')]
    sink.write_batch(one.where("object_id = 'b'"), 0, folder)  # a repeated try with fewer rows leaves none of the first
    assert listed() == [("j1", "d", "[1]"), ("j2", "b", '{"x": "ü"}')]
    part = sink.read_documents(spark, folder, "j2")
    assert [r.object_id for r in part.collect()] == ["b"] and "job_id#" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
    assert sink.read_documents(spark, folder, "j3").count() == 0


def test_sink_of_a_stream(spark, tmp_path):
    """A query that fails half-way and starts again writes each document once."""
    rows, folder = str(tmp_path / "rows"), str(tmp_path / "docs")
    for k in range(3):
        spark.createDataFrame([(f"j{k % 2}", f"o{k}{i}", json.dumps({"k": k})) for i in range(4)], "job_id string, object_id string, document string").coalesce(1).write.mode("append").parquet(rows)
    tried = []

    def failing(batch_rows, batch):
        sink.write_batch(batch_rows, batch, folder)
        tried.append(batch)
        if batch == 1:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        read(spark, rows, files=1).writeStream.foreachBatch(failing).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    sink.start(read(spark, rows, files=1), folder, str(tmp_path / "p")).awaitTermination()
    assert tried == [0, 1] and sink.read_documents(spark, folder).count() == sink.read_documents(spark, folder).select("object_id").distinct().count() == 12


def test_geometry(spark):
    o = spark.createDataFrame([(1, "a"), (2, "b")], "obj_id int, label string")
    p = spark.createDataFrame([(1, 1, 2.0), (1, 0, 1.0)], "obj_id int, pos int, x double")
    got = {r.obj_id: json.loads(r.d) for r in sink.with_geometry(o, p, "obj_id", ["x"]).select("obj_id", sink.document("label", "trajectory").alias("d")).collect()}
    assert got == {1: {"label": "a", "trajectory": [{"x": 1.0}, {"x": 2.0}]}, 2: {"label": "b", "trajectory": []}}
