"""Tables as streams, and streams as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumentrack.sources.store import home


def read(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream; ``files`` files a micro-batch (all that are there if not given)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, since a stream's plain path must be a folder


def drain(stream: DataFrame, tag: str) -> DataFrame:
    """All rows that the stream gives for what its source now holds, from a table in the shared folder.

    The query's offsets and state lie beside it, so a lost executor repeats a batch and not its output.
    """
    spark = stream.sparkSession
    place = home(spark, tag)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
