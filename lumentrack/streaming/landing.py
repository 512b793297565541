"""Uploads as a stream of the files that land in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrack.operators.service import gate

#: Largest upload in bytes, and the content types of file names (fixed values).
MAX_BYTES = 500 * 1024 * 1024
TYPES = {"mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "json": "application/json", "txt": "text/plain"}


def content_type(path: Column) -> Column:
    """The type that a file's name stands for; null for names that stand for none."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[suffix]


def uploads(spark: SparkSession, folder: str, most: int = MAX_BYTES, files: int | None = None) -> DataFrame:
    """A stream with a row for each file that lands in ``folder``: path, size, modified, content_type, status (200, 400 or 413), error.

    Only names, sizes and times are read, not what is in the files, so a refused upload costs nothing. ``files`` is the number
    of files a micro-batch (all that are there if not given). A file counts once, by its path, as long as the query's checkpoint lasts. Empty files give no row,
    as Spark's file source passes over them.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    seen = (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    seen = seen.withColumn("content_type", content_type(F.col("path")))
    status = gate(F.col("size"), F.col("content_type"), most)
    error = F.when(status == 400, "not a video").when(status == 413, F.lit(f"larger than {most} bytes"))
    return seen.withColumn("status", status).withColumn("error", error)


def land(stream: DataFrame, home: str) -> None:
    """Take in what has landed since the last call: ``home``/uploads holds the rows by status, ``home``/progress what has been seen.

    Run it again at any time, also after a failure: a micro-batch that was cut short is repeated, and its rows appear once.
    """
    stream.writeStream.format("parquet").partitionBy("status").option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start(f"{home}/uploads").awaitTermination()


def landed(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of ``land``; the accepted ones' contents are read with ``contents``."""
    rows = spark.read.parquet(f"{home}/uploads")
    return rows.where("status = 200").drop("error"), rows.where("status <> 200").select("path", "size", "status", "error")


def contents(spark: SparkSession, folder: str, accepted: DataFrame) -> DataFrame:
    """(path, content) of the accepted uploads; the size bound reaches the scan, so larger files are not opened."""
    most = accepted.agg(F.max("size")).first()[0] or 0
    return spark.read.format("binaryFile").load(folder).where(F.col("length") <= most).join(accepted.select("path"), "path", "left_semi").select("path", "content")
