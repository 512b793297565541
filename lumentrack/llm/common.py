"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09 to \x0D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Tasks that the rows of a hot key are dealt to.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lumentrack-")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's URI under spark.checkpoint.dir; where that is unset, under a temporary folder in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/lumentrack/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and the folder, for ``remove`` once nothing reads it any more."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return stored(df, tag)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that ``stored`` made."""
    for uri in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", like: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (inner or left) to ``unique``, which has a row a key at most, with the rows of hot keys dealt to many tasks.

    Hot are the hundred largest keys, those of over 200 rows; only their values reach the driver.
    Their rows are salted and met by copies of the key's one row. ``rows`` is read twice, or
    ``like`` in its stead the first time, which has its keys as often.
    """
    like = rows if like is None else like
    sizes = like.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 200")
    hot = [r[0] for r in sizes.orderBy(F.desc("_n")).limit(100).select(key).collect()]
    if not hot:
        return rows.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = unique.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def by_ids(docs: DataFrame, ids: DataFrame, how: str, most: int = 1_000_000) -> DataFrame:
    """``docs`` joined (left_semi or left_anti) to the distinct, stored ``ids`` (doc_id); up to ``most`` of them (8 bytes each) are broadcast, so that no text moves."""
    few = ids.count() <= most
    ids = ids.select(F.col("doc_id").alias("_id"))
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == F.col("_id"), how)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def held(**columns: Column) -> Column:
    """Generator of one row with these columns: computed once, and not inlined where they are used."""
    return F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))


def unit_hash(column: Column) -> Column:
    """A number in [0, 1) fixed by the value, for samples that do not depend on partitioning."""
    return F.shiftrightunsigned(F.xxhash64(column), 11) / F.lit(float(1 << 53))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids are in fold 0. Fold 2 is held out of all learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))
