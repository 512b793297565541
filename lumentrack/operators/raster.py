"""Mask and depth operators on pixel rows, boxes and confidences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.operators import masks as mk
from lumentrack.operators import shapes

#: Thresholds of mask quality (fixed values).
COVERAGE, GOOD_COVERAGE, WEIGHTS = (0.001, 0.95), (0.01, 0.30), (0.15, 0.30, 0.20, 0.20, 0.15)


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def mask_stats(pixels: DataFrame) -> DataFrame:
    """Per mask: area, coverage, centroid (0, 0 if empty), confidence (sigmoid of the mean |logit| inside), depth variance and consistency, aspect score."""
    inside = F.col("logit") > 0
    at = lambda c: F.when(inside, F.col(c))
    g = pixels.groupBy("mask_id", "frame").agg(
        F.count(F.when(inside, 1)).alias("area"), F.count("*").alias("size"), F.coalesce(F.avg(at("px")), F.lit(0.0)).alias("cx"), F.coalesce(F.avg(at("py")), F.lit(0.0)).alias("cy"),
        F.avg(F.when(inside, F.abs("logit"))).alias("strength"), F.var_pop(at("depth")).alias("spread"), F.var_samp(at("py")).alias("vyy"), F.var_samp(at("px")).alias("vxx"), F.covar_samp(at("py"), at("px")).alias("vxy"),
    )
    root = F.sqrt(F.pow(F.col("vyy") - F.col("vxx"), 2) + 4 * F.pow(F.col("vxy"), 2))
    high, low = (F.col("vyy") + F.col("vxx") + root) / 2, F.greatest(F.lit(0.0), (F.col("vyy") + F.col("vxx") - root) / 2)
    aspect = F.when(F.col("area") < 2, 0.0).when(high <= 1e-6, 1.0).when(low <= 0, 0.0).otherwise(F.exp(-0.5 * F.pow(F.log(F.sqrt(high / F.when(low > 0, low))), 2)))
    return g.select(
        "mask_id", "frame", "area", (F.col("area") / F.col("size")).alias("coverage"), "cx", "cy", F.coalesce(1 / (1 + F.exp(-F.col("strength"))), F.lit(0.0)).alias("confidence"),
        F.when(F.col("spread").isNull(), 0.0).otherwise(clip01(F.exp(-F.col("spread") / 2))).alias("depth_consistency"), aspect.alias("aspect"),
    )


def coverage_score(c: Column) -> Column:
    """0 outside the allowed coverage, 1 in the good range, linear between."""
    (low, high), (a, b) = COVERAGE, GOOD_COVERAGE
    return F.when((c < low) | (c > high), 0.0).when(c < a, (c - low) / (a - low)).when(c > b, 1 - (c - b) / (high - b)).otherwise(1.0)


def box_iou(pixels: DataFrame, boxes: DataFrame, width: int = 8, height: int = 8) -> DataFrame:
    """Mask against box by mask_id: box cut to whole pixels toward zero and to the raster; 0 for an empty union."""
    j = pixels.join(boxes, "mask_id")
    x0, y0 = F.greatest(F.lit(0), F.col("bx").cast("int")), F.greatest(F.lit(0), F.col("by_").cast("int"))
    x1, y1 = F.least(F.lit(width), F.col("bx").cast("int") + F.col("bw").cast("int")), F.least(F.lit(height), F.col("by_").cast("int") + F.col("bh").cast("int"))
    box = (F.col("px") >= x0) & (F.col("px") < x1) & (F.col("py") >= y0) & (F.col("py") < y1)
    mask = F.col("logit") > 0
    g = j.groupBy("mask_id").agg(F.count(F.when(box & mask, 1)).alias("n"), F.count(F.when(box | mask, 1)).alias("u"))
    return g.select("mask_id", F.when(F.col("u") == 0, 0.0).otherwise(F.col("n") / F.when(F.col("u") > 0, F.col("u"))).alias("iou"))


def bilinear(depths: Column, x: Column, y: Column, width: int = 8, height: int = 8) -> Column:
    """Depth at a sub-pixel place of a row-major array: clamped, from the four corners."""
    x, y = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), x)), F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), y))
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
    at = lambda i, j: F.get(depths, j * width + i)
    fx, fy = x - x0, y - y0
    return at(x0, y0) * (1 - fx) * (1 - fy) + at(x1, y0) * fx * (1 - fy) + at(x0, y1) * (1 - fx) * fy + at(x1, y1) * fx * fy


def _trace(mask: np.ndarray) -> tuple[float, int]:
    """(perimeter of the outer border that encloses most, number of 8-connected components) of one raster."""
    y, x = np.nonzero(mask)
    found = shapes.measure(np.array([mask.shape[0]]), np.array([mask.shape[1]]), np.zeros(len(y), int), y, x, x + 1)
    return float(found["perimeter"][0]), int(found["n_components"][0])


def as_runs(rasters: DataFrame, width: int = 8) -> DataFrame:
    """Rasters of logits (mask_id, ..., logits) as masks (..., height, width, runs)."""
    return rasters.withColumns({"height": F.floor(F.size("logits") / width).cast("int"), "width": F.lit(width), "runs": mk.runs(F.col("logits"), width)})


def mask_shape(rasters: DataFrame, width: int = 8) -> DataFrame:
    """mask_id, perimeter, compactness, n_components, fragmentation, edge of each raster of logits; empty masks: 0, 0, 0, 1, 0."""
    names = ["mask_id", "perimeter", "compactness", "n_components", "fragmentation", "edge"]
    return shapes.mask_shape(as_runs(rasters.select("mask_id", "logits"), width).drop("logits")).select(*names)


def mask_quality(masks: DataFrame) -> DataFrame:
    """Masks (height, width, runs, ...) with coverage, their shape, aspect, overall score and is_valid, the five-threshold verdict. Rows stay where they are."""
    s = shapes.mask_shape(masks).withColumn("coverage", mk.area(F.col("runs")) / (F.col("height") * F.col("width"))).withColumn("aspect", shapes.aspect(F.col("runs")))
    parts = [coverage_score(F.col("coverage")), F.col("compactness"), F.col("edge"), F.col("fragmentation"), F.col("aspect")]
    s = s.withColumn("overall", sum(w * p for w, p in zip(WEIGHTS, parts, strict=True)))
    valid = F.col("coverage").between(*COVERAGE) & (F.col("compactness") >= 0.1) & (F.col("edge") >= 0.2) & (F.col("n_components") <= shapes.MAX_FRAGMENTS) & (F.col("overall") >= 0.4) & ~F.isnan("overall")
    return s.withColumn("is_valid", valid)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda within refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mirrored(i: Column, n: Column) -> Column:
    """An index with the border's pixels repeated outwards."""
    k = F.pmod(i, 2 * n)
    return F.when(k < n, k).otherwise(2 * n - 1 - k)


def boxes(values: Column, names: str, height: Column, width: Column) -> Column:
    """Sums over 5 x 5 pixels of the fields ``names`` (a letter each) of a row-major array of structs: of five along the rows, then of five of those along the columns. Border pixels repeat."""
    near = range(-2, 3)
    places = lambda v: F.sequence(F.lit(0), F.size(v) - 1)
    total = lambda parts: F.struct(*[sum((p[c] for p in parts[1:]), parts[0][c]).alias(c) for c in names])
    along = lambda v, i: total([F.get(v, i - i % width + _mirrored(i % width + k, width)) for k in near])
    down = lambda rows, i: total([F.get(rows, _mirrored(F.floor(i / width).cast("int") + k, height) * width + i % width) for k in near])
    return let(values, lambda v: let(F.transform(places(v), lambda i: along(v, i)), lambda rows: F.transform(places(rows), lambda i: down(rows, i))))


def slopes(values: Column, i: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """Differences along x and y at place ``i`` of a row-major array: central, one-sided at the border; 0 along a side of one pixel."""

    def slope(at, last, step):
        low, high = F.when(at > 0, i - step).otherwise(i), F.when(at < last, i + step).otherwise(i)
        return F.coalesce(F.try_divide(F.get(values, high) - F.get(values, low), F.when(at > 0, 1).otherwise(0) + F.when(at < last, 1).otherwise(0)), F.lit(0.0))

    return slope(i % width, width - 1, F.lit(1)), slope(F.floor(i / width).cast("int"), height - 1, width)


def _uncertainty(depth: Column, height: Column, width: Column) -> Column:
    """Variance over 5 x 5 pixels plus half the gradient, pixel by pixel."""

    def score(b, i):
        mean = b["s"] / 25
        gx, gy = slopes(depth, i, height, width)
        return F.greatest(F.lit(0.0), b["q"] / 25 - mean * mean) + 0.5 * F.sqrt(gx * gx + gy * gy)

    return F.transform(boxes(F.transform(depth, lambda v: F.struct(v.alias("s"), (v * v).alias("q"))), "sq", height, width), score)


def depth_confidence(maps: DataFrame, low: float = 0.1, high: float = 100.0) -> DataFrame:
    """Depth maps (height, width, depth row-major, ...) of any size with valid_ratio, mean_uncertainty and confidence.

    Pixels outside the range are invalid and clipped; null and NaN ones count as the lower end. A map's uncertainty is over its largest;
    that of invalid pixels is 1. Without a valid pixel the confidence is 0, and the ratio and the uncertainty of an empty or null map
    are 0 and 1. No row moves and no pixel becomes a row.
    """
    depth, height, width = F.coalesce("depth", F.array().cast("array<double>")), F.col("height").cast("int"), F.col("width").cast("int")
    valid = F.transform(depth, lambda v: F.coalesce(v.between(low, high) & ~F.isnan(v), F.lit(False)))
    clipped = F.transform(depth, lambda v: F.when(v.isNull() | F.isnan(v), low).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), v))))
    zero = F.lit(0.0)

    def summed(d):
        def totals(u):
            top = F.greatest(zero, F.array_max(u))
            pixels = F.zip_with(F.zip_with(d, u, lambda v, s: F.struct(v.alias("d"), F.when(top > 0, s / F.when(top > 0, top)).otherwise(s).alias("u"))), valid, lambda p, ok: F.struct(p["d"].alias("d"), F.when(ok, p["u"]).otherwise(1.0).alias("u"), F.when(ok, 1.0).otherwise(0.0).alias("ok")))
            add = lambda t, p: F.struct((t["n"] + p["ok"]).alias("n"), (t["u"] + p["u"]).alias("u"), (t["uv"] + p["u"] * p["ok"]).alias("uv"), (t["d"] + p["d"] * p["ok"]).alias("d"), (t["q"] + p["d"] * p["d"] * p["ok"]).alias("q"))
            return F.aggregate(pixels, F.struct(*[zero.alias(c) for c in ("n", "u", "uv", "d", "q")]), add)

        return let(F.transform(d, lambda v: v - F.get(d, F.lit(0))), lambda moved: let(_uncertainty(moved, height, width), totals))  # small numbers, so that flat maps have no spread at all

    t = F.when(F.size(depth) > 0, let(clipped, summed))
    rows = maps.select("*", F.inline(F.array(F.struct(t.alias("_t")))))  # a generator, so that the sums are made once
    n, some = F.col("_t.n"), F.col("_t.n") > 0
    spread = F.sqrt(F.greatest(zero, F.try_divide("_t.q", n) - F.pow(F.try_divide("_t.d", n), 2)))
    conf = 0.5 * (1 - F.try_divide("_t.uv", n)) + 0.3 * n / F.size("depth") + 0.2 * (1 - F.least(F.lit(1.0), spread / 50))
    return rows.withColumns({
        "valid_ratio": F.when(F.col("_t").isNull(), 0.0).otherwise(n / F.greatest(F.size("depth"), F.lit(1))), "mean_uncertainty": F.when(F.col("_t").isNull(), 1.0).otherwise(F.col("_t.u") / F.greatest(F.size("depth"), F.lit(1))),
        "confidence": F.when(some, conf).otherwise(0.0),
    }).drop("_t")
