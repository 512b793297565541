"""Views of the driver's tables as the engine's data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tracks(events: DataFrame) -> DataFrame:
    """Track points (obj_id, pos, t seconds, x, y, z) from events of a user in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("obj_id"), (F.row_number().over(order) - 1).alias("pos"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.hour("ts").cast("double").alias("z"), F.col("event_type").alias("label"),
    )


def rasters(embeddings: DataFrame) -> DataFrame:
    """8 x 8 logits (mask_id, frame, logits array<double>): a mask is logit > 0."""
    return embeddings.select(F.col("vec_id").alias("mask_id"), F.col("label").alias("frame"), F.col("embedding").cast("array<double>").alias("logits"))


def pixels(rasters: DataFrame, width: int = 8) -> DataFrame:
    """(mask_id, frame, px, py, logit, depth): a row a pixel; depth is 5 + 10 * logit metres, clipped to 0.1 to 100."""
    p = rasters.select("mask_id", "frame", F.posexplode("logits").alias("p", "logit"))
    depth = F.greatest(F.lit(0.1), F.least(F.lit(100.0), 5 + 10 * F.col("logit")))
    return p.select("mask_id", "frame", (F.col("p") % width).alias("px"), F.floor(F.col("p") / width).cast("int").alias("py"), "logit", depth.alias("depth"))


def detections(lineitem: DataFrame) -> DataFrame:
    """Boxes (frame, ord, x, y, w, h, confidence) of order lines; ord numbers a frame's boxes."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lineitem.select(
        F.col("l_orderkey").alias("frame"), (F.row_number().over(order)).alias("ord"), (F.col("l_quantity") * 2).alias("x"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("y"),
        (10 + F.col("l_linenumber") * 3).cast("double").alias("w"), (F.col("l_quantity") + 5).alias("h"), (1 - F.col("l_discount")).alias("confidence"),
    )


def r6(c: Column) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(c, 6) + 0.0


#: The same views in DuckDB SQL.
SQL = {
    "tr": "tr AS (SELECT user_id AS obj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, epoch_us(ts) / 1e6 AS t, value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y, CAST(hour(ts) AS DOUBLE) AS z, event_type AS label FROM events)",
    "px": "px AS (SELECT mask_id, frame, (i - 1) % 8 AS px, (i - 1) // 8 AS py, CAST(e[i] AS DOUBLE) AS logit, greatest(0.1::DOUBLE, least(100.0::DOUBLE, 5 + 10 * CAST(e[i] AS DOUBLE))) AS depth FROM (SELECT vec_id AS mask_id, label AS frame, embedding AS e, unnest(generate_series(1, 64)) AS i FROM embeddings))",
    "dt": "dt AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_quantity * 2 AS x, l_quantity + l_tax * 100 AS y, CAST(10 + l_linenumber * 3 AS DOUBLE) AS w, l_quantity + 5 AS h, 1 - l_discount AS confidence FROM lineitem)",
}
