"""JSON documents of results: an idempotent sink by batch, and its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document's columns beside its batch.
FIELDS = ("job_id", "object_id", "document")


def with_geometry(objects: DataFrame, points: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``objects`` with ``trajectory``: their points (key, pos, fields) in order of pos. An array holds one object's points, at most a point a sampled frame."""
    place = F.struct("pos", *fields)
    own = points.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(place)), lambda p: F.struct(*[p[f].alias(f) for f in fields])).alias("trajectory"))
    return objects.join(own, key, "left").withColumn("trajectory", F.coalesce("trajectory", F.array().cast(own.schema["trajectory"].dataType)))


def document(*fields: str) -> Column:
    """The JSON document of these columns; null fields are kept as nulls."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Write a batch (job_id, object_id, document) as JSON lines under ``folder``/batch=N, in the place of what an earlier try of it left.

    Files are partitioned by job beneath the batch, so that a job's download reads only its own. Other batches stay as they are.
    An empty batch leaves nothing, also where an earlier try had rows.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    rows.select(*FIELDS).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "job_id").json(folder)


def start(stream: DataFrame, folder: str, progress: str):
    """The streaming query that writes each micro-batch of documents once, however often it is tried."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, folder)).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_documents(spark: SparkSession, folder: str, job_id: str | None = None) -> DataFrame:
    """(job_id, object_id, document) of all batches, or of one job: its files alone are read."""
    rows = spark.read.schema("object_id string, document string, batch long, job_id string").json(folder)
    return (rows if job_id is None else rows.where(F.col("job_id") == job_id)).select(*FIELDS)
