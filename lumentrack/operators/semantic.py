"""Label matching, consensus, confidence and the JSON of semantic models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import clip01

#: Patterns of the text heuristic (fixed values).
ERRORS = ("error", "failed", "unable", "cannot", "sorry", "don't know")
POSITIVE = ("object", "trajectory", "position", "movement", "detected")
#: Aliases of a semantic object's fields, in order of precedence (fixed values).
LABEL_KEYS, BOX_KEYS, LIST_KEYS = ("label", "object_id", "class"), ("bbox", "bounding_box", "box"), ("objects", "trajectories", "detections")


def best_match(pairs: DataFrame, objects: DataFrame, least_iou: float = 0.3) -> DataFrame:
    """(obj_id, ord, label, iou) pairs -> one label an object: best confidence (IoU, a fifth more for a real label), first wins ties; else a fallback."""
    real = (F.coalesce(F.length("label"), F.lit(0)) > 0) & ~F.coalesce(F.startswith(F.col("label"), F.lit("object_")), F.lit(False))
    p = pairs.where(F.col("iou") >= least_iou).withColumn("confidence", clip01(F.col("iou") * F.when(real, 1.2).otherwise(1.0)))
    best = p.groupBy("obj_id").agg(F.max_by(F.struct("label", "confidence", "iou"), F.struct("confidence", -F.col("ord"))).alias("m"))
    j = objects.join(best, "obj_id", "left")
    return j.select("obj_id", F.coalesce("m.label", F.concat(F.lit("object_"), F.col("obj_id"))).alias("label"), F.coalesce("m.confidence", F.lit(0.5)).alias("confidence"), F.when(F.col("m").isNull(), "fallback").otherwise("spatial").alias("method"))


def consensus(votes: DataFrame) -> DataFrame:
    """(obj_id, pos, label) -> majority label from three votes on, the smallest of tied labels; under three the first seen."""
    counts = votes.groupBy("obj_id", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = F.row_number().over(Window.partitionBy("obj_id").orderBy(F.desc("n"), "label"))
    total = F.sum("n").over(Window.partitionBy("obj_id"))
    early = F.first("label").over(Window.partitionBy("obj_id").orderBy("first"))
    return counts.select("obj_id", F.when(total >= 3, F.col("label")).otherwise(early).alias("label"), "n", total.alias("votes"), top.alias("rank")).where("rank = 1").drop("rank")


def refine(matches: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Labels with a parent in (parent, child) gain a tenth of confidence; the label stays."""
    parents = hierarchy.groupBy(F.lower("child").alias("key")).agg(F.min("parent").alias("parent"))
    j = matches.join(F.broadcast(parents) if hierarchy.limit(10_001).count() <= 10_000 else parents, F.lower("label") == F.col("key"), "left")
    up = F.coalesce("parent", "label")
    return j.select(*[c for c in matches.columns if c != "confidence"], up.alias("parent"), F.when(up != F.col("label"), F.col("confidence") * 1.1).otherwise(F.col("confidence")).alias("confidence"))


def text_confidence(text: Column) -> Column:
    """Heuristic confidence of a model's text, from its length, braces, and words of failure and success anywhere in it, in any case; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    n, low = F.length(text), F.lower(text)
    c = F.lit(0.7) * F.when(n < 50, 0.5).when(n > 2000, 0.8).otherwise(1.0) * F.when(F.contains(text, F.lit("{")) & F.contains(text, F.lit("}")), 1.1).otherwise(0.5)
    for word in ERRORS:
        c = c * F.when(F.contains(low, F.lit(word)), 0.6).otherwise(1.0)
    return clip01(c * (1 + 0.05 * sum(F.contains(low, F.lit(word)).cast("int") for word in POSITIVE)))


def parsed(texts: DataFrame) -> DataFrame:
    """(id, text, confidence) -> id, parse_success, confidence: three tenths of it where the text between its outer braces is no JSON, a fifth where it has none."""
    body = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)(\{.*\})", 1)
    good = F.try_parse_json(F.when(body != "", body)).isNotNull()
    return texts.select("id", good.alias("parse_success"), (F.col("confidence") * F.when(body == "", 0.2).when(good, 1.0).otherwise(0.3)).alias("confidence"))


def answer(text: Column) -> Column:
    """The variant of a model's text: a text that is a JSON list as a whole, else what lies between the outer braces; null if that is no JSON."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(F.try_parse_json(F.when(F.startswith(trimmed, F.lit("[")), trimmed)), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))))


def _part(v: Column, path: str) -> Column:
    """A part of a variant as it is; null only where it is absent."""
    return F.try_variant_get(v, path, "variant")


def truthy(v: Column) -> Column:
    """Whether a variant is there and is more than null, false, zero, an empty text, list or object."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return F.when(v.isNull() | kind.isin("VOID", "OBJECT<>"), False).when(kind == "STRING", F.try_variant_get(v, "$", "string") != "").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(
        F.startswith(kind, F.lit("ARRAY")), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0).otherwise(F.coalesce(number != 0, F.lit(True)))


def _first_true(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(truthy(_part(v, f"$.{k}")), _part(v, f"$.{k}")) for k in keys])


def _items(v: Column) -> Column:
    """The elements of a list; none of anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def fallback_label(texts: DataFrame, objects: DataFrame) -> DataFrame:
    """Labels without spatial matching: (id, text), (id, obj_id) -> id, obj_id, label, behaviour.

    The first object in ``trajectories``, or if that is empty or absent in ``objects``, names every mask by its object_id,
    else its label; an empty name, or the mask's own, leaves ``object_`` and the number. Lists that aren't empty end the search,
    whatever is in them. behaviour is the object's action, else its behavior, else stationary.
    """
    v = texts.select("id", answer(F.col("text")).alias("v"))
    lists = v.select("id", _part(F.col("v"), "$.trajectories").alias("t"), _part(F.col("v"), "$.objects").alias("o"))
    chosen = lists.select("id", F.get(F.filter(_items(F.when(truthy(F.col("t")), F.col("t")).otherwise(F.col("o"))), _is_object), 0).alias("o"))
    text = lambda *keys: F.try_variant_get(_first_true(F.col("o"), keys), "$", "string")
    named = chosen.select("id", text("object_id", "label").alias("name"), F.coalesce(text("action", "behavior"), F.lit("stationary")).alias("behaviour"))
    own = F.concat(F.lit("object_"), F.col("obj_id"))
    return objects.join(named, "id", "left").select("id", "obj_id", F.coalesce("name", own).alias("label"), F.coalesce("behaviour", F.lit("stationary")).alias("behaviour"))


def cross_modal(s: Column, d: Column, c: Column, k: Column) -> Column:
    """Confidence over segmentation, depth, semantics and consistency; 0.7 where one of the first three is missing or zero."""
    known = (F.coalesce(s, F.lit(0.0)) != 0) & d.isNotNull() & (F.coalesce(c, F.lit(0.0)) != 0)
    return F.when(known, clip01(F.pow(s, F.lit(0.4)) * F.pow(d, F.lit(0.3)) * F.pow(c, F.lit(0.3)) * (0.5 + 0.5 * k))).otherwise(0.7)


def overall_consistency(iou: Column, distance: Column, depth: Column) -> Column:
    return clip01(0.4 * iou + 0.3 * (1 - F.least(F.lit(1.0), distance / 0.2)) + 0.3 * depth)


def json_objects(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, ord, label, bbox json, confidence) of the objects in a model's answer; ord counts all elements of their list.

    The list is that of the first key of LIST_KEYS that is present, or the answer itself if it is a list; a present key that
    holds no list has no objects, and ends the search. Elements that are no objects are passed over. Of aliases the first that isn't empty,
    zero, false or null counts; a label that none has is unknown. A confidence that is absent is 1; one that is null or no number is null.
    """
    v = F.col("v")
    held = F.coalesce(*[_part(v, f"$.{k}") for k in LIST_KEYS], F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), v))
    p = texts.select("id", answer(F.col("text")).alias("v")).select("id", held.alias("held")).select("id", F.posexplode(_items(F.col("held"))).alias("ord", "o")).where(_is_object(F.col("o")))
    o = F.col("o")
    text = lambda keys: F.try_variant_get(_first_true(o, keys), "$", "string")
    sure = F.when(_part(o, "$.confidence").isNull(), 1.0).otherwise(F.try_variant_get(o, "$.confidence", "double"))
    return p.select("id", "ord", F.coalesce(text(LABEL_KEYS), F.lit("unknown")).alias("label"), text(BOX_KEYS).alias("bbox"), sure.alias("confidence"))
