"""Masks of any size as runs: rows (frame, obj_id, height, width, runs), where a run is (y, x0, x1) of pixels inside, x1 exclusive.

Overlaps are counted block by block: a frame's masks are dealt into blocks by place, and only blocks that may hold a pair meet.
Runs of a mask don't overlap each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.sources.store import stored

#: Pixels of a tile's side, a word of bits.
TILE = 64
#: About how many runs, and how many masks, a block holds; and pairs that a task counts at a time. These change memory and speed only.
LOAD, BLOCK, STRIP = 200_000, 8_000, 1 << 19
#: Masks of a crowded frame that suppression decides at a time.
LEAD = 512


def runs(values: Column, width: int, above: float = 0.0) -> Column:
    """Runs of a row-major raster where its values exceed ``above`` (0 for logits, 0.5 for probabilities)."""
    inside = lambda i: F.coalesce(F.get(values, i) > above, F.lit(False))
    places = F.filter(F.sequence(F.lit(0), F.size(values) - 1), inside)
    starts = F.filter(places, lambda i: (i % width == 0) | ~inside(i - 1))
    ends = F.filter(places, lambda i: (i % width == width - 1) | ~inside(i + 1))
    made = F.zip_with(starts, ends, lambda a, b: F.struct(F.floor(a / width).cast("int").alias("y"), (a % width).cast("int").alias("x0"), (b % width + 1).cast("int").alias("x1")))
    return F.when(F.size(values) > 0, made).otherwise(F.slice(made, 1, 0))


def area(r: Column) -> Column:
    """Pixels of a mask."""
    return F.aggregate(r, F.lit(0).cast("long"), lambda n, s: n + s["x1"] - s["x0"])


def centroid(r: Column) -> tuple[Column, Column]:
    """Mean x and y of a mask's pixels; 0 and 0 where it has none."""
    n = area(r)
    x = F.aggregate(r, F.lit(0.0), lambda t, s: t + (s["x1"] - s["x0"]) * (s["x0"] + s["x1"] - 1) / 2)
    y = F.aggregate(r, F.lit(0.0), lambda t, s: t + (s["x1"] - s["x0"]) * s["y"])
    return F.when(n > 0, x / n).otherwise(0.0), F.when(n > 0, y / n).otherwise(0.0)


def weighted_centroid(r: Column, values: Column, width: Column | int) -> Column:
    """struct<x, y>: mean place of a mask's pixels, weighted by the row-major raster ``values``; null where the weights add up to nothing. Missing values weigh nothing."""
    pixel = lambda s, x: F.struct(x.cast("double").alias("x"), s["y"].cast("double").alias("y"), F.coalesce(F.get(values, s["y"] * width + x), F.lit(0.0)).alias("w"))
    pixels = F.flatten(F.transform(F.filter(r, lambda s: s["x1"] > s["x0"]), lambda s: F.transform(F.sequence(s["x0"], s["x1"] - 1), lambda x: pixel(s, x))))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "wxy"])
    add = lambda t, p: F.struct((t["w"] + p["w"]).alias("w"), (t["x"] + p["w"] * p["x"]).alias("x"), (t["y"] + p["w"] * p["y"]).alias("y"))
    return F.aggregate(pixels, zero, add, lambda t: F.when(t["w"] != 0, F.struct((t["x"] / F.when(t["w"] != 0, t["w"])).alias("x"), (t["y"] / F.when(t["w"] != 0, t["w"])).alias("y"))))


def inside(r: Column, values: Column, width: Column | int) -> Column:
    """The values of a row-major raster under a mask."""
    return F.flatten(F.transform(r, lambda s: F.slice(values, s["y"] * width + s["x0"] + 1, s["x1"] - s["x0"])))


def box_iou(r: Column, box: Column, width: int, height: int) -> Column:
    """Mask against a box (x, y, w, h), which is cut to whole pixels toward zero and to the frame; 0 for an empty union."""
    x, y, w, h = (box[c].cast("int") for c in "xywh")
    x0, y0, x1, y1 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y), F.least(F.lit(width), x + w), F.least(F.lit(height), y + h)
    size = F.greatest(F.lit(0), x1 - x0) * F.greatest(F.lit(0), y1 - y0)
    met = F.aggregate(r, F.lit(0).cast("long"), lambda n, s: n + F.when((s["y"] >= y0) & (s["y"] < y1), F.greatest(F.lit(0), F.least(s["x1"], x1) - F.greatest(s["x0"], x0))).otherwise(0))
    union = area(r) + size - met
    return F.when(union > 0, met / union).otherwise(0.0)


def min_area(masks: DataFrame, least: float = 0.001) -> DataFrame:
    """Masks of at least this share of their frame."""
    return masks.where(area(F.col("runs")) / (F.col("height") * F.col("width")) >= least)


def _loads(masks: DataFrame) -> DataFrame:
    """(frame, obj_id, area, runs as arrays y, x0 and x1, edges, load) of the masks with pixels; a mask's load is the number of its runs cut at the tiles' sides."""
    take = lambda c: F.transform("runs", lambda s: s[c].cast("int")).alias(c)
    rows = masks.where(F.col("frame").isNotNull() & (area(F.col("runs")) > 0)).select("frame", "obj_id", area(F.col("runs")).alias("area"), take("y"), take("x0"), take("x1"))
    cuts = F.size("x0") + F.floor(F.col("area") / TILE)
    return rows.withColumns({"load": F.greatest(cuts, F.lit(LOAD // BLOCK)), "top": F.array_min("y"), "bottom": F.array_max("y"), "left": F.array_min("x0"), "right": F.array_max("x1")})


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of ``_loads`` with their block: a frame's masks are one, or where they are too many, those whose middle is in one tile, dealt by hash."""
    spot = {"ty": F.floor((F.col("top") + F.col("bottom")) / (2 * TILE)), "tx": F.floor((F.col("left") + F.col("right")) / (2 * TILE))}
    rows = rows.withColumns(spot)
    tiles = rows.groupBy("frame", "ty", "tx").agg(F.sum("load").alias("own"))
    tiles = tiles.withColumn("all", F.sum("own").over(Window.partitionBy("frame"))).select("frame", "ty", "tx", (F.col("all") <= LOAD).alias("whole"), F.ceil(F.col("own") / LOAD).alias("slots"))
    slot = F.pmod(F.xxhash64("obj_id"), F.col("slots"))
    block = F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.xxhash64("ty", "tx", slot))
    return rows.join(tiles, ["frame", "ty", "tx"]).withColumn("block", block).drop("ty", "tx", "whole", "slots")


def _blocks(rows: DataFrame) -> DataFrame:
    """Edges, areas and load of each block."""
    return rows.groupBy("frame", "block").agg(*[f(c).alias(c) for c, f in (("top", F.min), ("bottom", F.max), ("left", F.min), ("right", F.max))], F.min("area").alias("least"), F.max("area").alias("most"), F.sum("load").alias("load"))


class _Block:
    """Masks of a block in a task: their runs, cut at tiles' sides."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.area = batch.column("obj_id"), batch.column("area").to_numpy().astype(np.int64)
        y, x0, x1 = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        owner = np.repeat(np.arange(len(self.area)), np.diff(batch.column("y").offsets.to_numpy()))
        some = x1 > x0
        y, x0, x1, owner = y[some], x0[some], x1[some], owner[some]
        first = x0 // TILE
        cuts = (x1 - 1) // TILE - first + 1
        part = np.repeat(np.arange(len(y)), cuts)
        tx = first[part] + np.arange(len(part)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start, stop = np.maximum(x0[part] - tx * TILE, 0), np.minimum(x1[part] - tx * TILE, TILE)
        word = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (TILE - (stop - start)).astype(np.uint64)) << start.astype(np.uint64)
        order = np.lexsort((owner[part], tx, y[part] // TILE))
        ty, tx, self.owner, self.y, self.word = y[part][order] // TILE, tx[order], owner[part][order], y[part][order] % TILE, word[order]
        starts = np.flatnonzero(np.concatenate([[True], (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])]))
        self.tiles = {(int(ty[a]), int(tx[a])): (a, b) for a, b in zip(starts, [*starts[1:], len(ty)], strict=True)}

    def pixels(self, tile: tuple[int, int], first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the masks from ``first`` to ``last`` have pixels in a tile, and a row of its bits for each."""
        a, b = self.tiles[tile]
        a, b = a + np.searchsorted(self.owner[a:b], (first, last))
        some, at = np.unique(self.owner[a:b], return_inverse=True)
        rows = np.zeros((len(some), TILE), np.uint64)
        np.bitwise_or.at(rows, (at, self.y[a:b]), self.word[a:b])
        return some, np.unpackbits(rows.view(np.uint8), axis=1)


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _near(a: _Block, b: _Block, above: float):
    """(places in a, places in b, iou) of the pairs above the share, for a few masks of a at a time; each pair once if both are one block."""
    known = {}
    for tile in a.tiles.keys() & b.tiles.keys():
        some, bits = b.pixels(tile, 0, len(b.area))
        used = np.flatnonzero(bits.any(axis=0))
        known[tile] = some, used, _words(bits[:, used])
    need = above / (1 + above) * (1 - 1e-9)  # n / (x + y - n) > above as a bound on n, a little low; survivors are divided
    step = max(1, STRIP // len(b.area))
    for first in range(0, len(a.area), step):
        last = min(first + step, len(a.area))
        common = np.zeros((last - first, len(b.area)), np.int32)
        for tile, (some_b, used, words_b) in known.items():
            some_a, bits = a.pixels(tile, first, last)
            if not len(some_a):
                continue
            words_a = _words(bits[:, used])
            n = np.zeros((len(some_a), len(some_b)), np.int32)
            for k in range(words_b.shape[1]):
                n += np.bitwise_count(words_a[:, k, None] & words_b[None, :, k])
            common[np.ix_(some_a - first, some_b)] += n
        x, y = np.nonzero((common > 0) & (common >= need * a.area[first:last, None] + need * b.area[None, :]))
        x, n = x + first, common[x, y]
        iou = n / (a.area[x] + b.area[y] - n)
        keep = iou > above
        keep &= (x < y) if a is b else True
        if keep.any():
            yield x[keep], y[keep], iou[keep]


def _cells(batches):
    """(frame, first block, second block or the same) of every cell of a task, whose rows come sorted by cell and side."""
    held = []

    def done():
        every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        side = every.column("side").to_numpy()
        cut = int(np.searchsorted(side, 1))
        own = _Block(every.slice(0, cut))
        return every.column("frame").slice(0, 1), own, _Block(every.slice(cut)) if cut < len(side) else own

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("frame", "lo", "hi")]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in ("frame", "lo", "hi")):
                yield done()
                held = []
            held.append(part)
    if held:
        yield done()


def _met(rows: DataFrame, others: DataFrame | None, above: float) -> DataFrame:
    """Rows of both sides in the cells where two of their blocks meet, sorted; the blocks of one table with each other if ``others`` is none."""
    rows = stored(_dealt(rows), "mask-blocks")
    other_rows = rows if others is None else stored(_dealt(others), "mask-blocks")
    edges = ("top", "bottom", "left", "right", "least", "most", "load")
    side = lambda df, k: _blocks(df).select("frame", F.col("block").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in edges])
    a, b = side(rows, "lo"), side(other_rows, "hi")
    near = (F.col("top_lo") <= F.col("bottom_hi")) & (F.col("top_hi") <= F.col("bottom_lo")) & (F.col("left_lo") < F.col("right_hi")) & (F.col("left_hi") < F.col("right_lo"))
    near = near & (F.col("most_lo") >= above * F.col("least_hi")) & (F.col("most_hi") >= above * F.col("least_lo"))
    near = near & (F.col("lo") <= F.col("hi")) if others is None else near
    cells = stored(a.join(b, "frame").where(near).select("frame", "lo", "hi", (F.col("load_lo") + F.col("load_hi")).alias("load")), "mask-cells")
    n, load = cells.agg(F.count("*"), F.sum("load")).first()
    left = rows.join(cells.select("frame", F.col("lo").alias("block"), "lo", "hi"), ["frame", "block"]).withColumn("side", F.lit(0))
    right = cells.select("frame", F.col("hi").alias("block"), "lo", "hi")
    right = other_rows.join(right.where("lo <> hi") if others is None else right, ["frame", "block"]).withColumn("side", F.lit(1))
    parts = max(1, min(n, 64 + (load or 0) // LOAD))
    both = left.unionByName(right).select("frame", "lo", "hi", "side", "obj_id", "area", "y", "x0", "x1")
    return both.repartition(parts, "frame", "lo", "hi").sortWithinPartitions("frame", "lo", "hi", "side")


def overlaps(masks: DataFrame, above: float) -> DataFrame:
    """(frame, a, b, iou) of the pairs a < b of one frame whose IoU exceeds ``above`` (0 or more); masks without a common pixel never meet.

    A frame's masks are dealt into blocks, and two blocks that may hold a pair meet in a task, which counts common pixels in bits and yields final
    rows. So masks are moved once for each block that theirs meets, and pairs are not moved at all.
    """
    schema = masks.select("frame", F.col("obj_id").alias("a"), F.col("obj_id").alias("b"), F.lit(0.0).alias("iou")).schema

    def run(batches):
        for frame, own, other in _cells(batches):
            for x, y, iou in _near(own, other, above):
                yield pa.RecordBatch.from_arrays([frame.take(pa.array(np.zeros(len(x), np.int64))), own.ids.take(pa.array(x)), other.ids.take(pa.array(y)), pa.array(iou)], ["frame", "a", "b", "iou"])

    pairs = _met(_loads(masks), None, above).mapInArrow(run, schema)
    return pairs.where("a <> b").select("frame", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "iou")


def _overlapped(masks: DataFrame, by: DataFrame, above: float) -> DataFrame:
    """(frame, obj_id) of the ``masks`` that one of ``by`` overlaps by more than ``above``; some of them repeated."""
    schema = masks.select("frame", "obj_id").schema

    def run(batches):
        for frame, own, other in _cells(batches):
            hit = np.zeros(len(other.area), bool)
            for _, y, _ in _near(own, other, above):
                hit[y] = True
            yield pa.RecordBatch.from_arrays([frame.take(pa.array(np.zeros(int(hit.sum()), np.int64))), other.ids.filter(pa.array(hit))], ["frame", "obj_id"])

    return _met(_loads(by), _loads(masks), above).mapInArrow(run, schema)


def _greedy(rows: DataFrame, threshold: float) -> DataFrame:
    """Suppression by all pairs that overlap: each mask knows those before it that do, and the masks that any does stream through a task a frame, which remembers the numbers of those gone."""
    rank = rows.select("frame", "obj_id", "rank")
    side = lambda k: rank.select("frame", F.col("obj_id").alias(k), F.col("rank").alias(f"rank_{k}"))
    pairs = overlaps(rows, threshold).join(side("a"), ["frame", "a"]).join(side("b"), ["frame", "b"])
    first = F.col("rank_a") < F.col("rank_b")
    before = pairs.groupBy("frame", F.when(first, F.col("b")).otherwise(F.col("a")).alias("obj_id")).agg(F.collect_list(F.when(first, F.col("a")).otherwise(F.col("b"))).alias("before"))
    order = rank.join(before, ["frame", "obj_id"]).repartition("frame").sortWithinPartitions("frame", "rank").select("frame", "obj_id", "before")
    schema = order.select("frame", "obj_id").schema

    def run(batches):
        at, gone = object(), set()
        for pdf in batches:
            out = []
            for frame, obj_id, before in zip(pdf["frame"], pdf["obj_id"], pdf["before"], strict=True):
                if frame != at:
                    at, gone = frame, set()
                if any(e not in gone for e in before):
                    gone.add(obj_id)
                    out.append((frame, obj_id))
            yield pd.DataFrame(out, columns=["frame", "obj_id"])

    return rank.select("frame", "obj_id").join(order.mapInPandas(run, schema), ["frame", "obj_id"], "left_anti")


def nms(masks: DataFrame, threshold: float = 0.7, lead: int = LEAD) -> DataFrame:
    """(frame, obj_id) that stay: by confidence descending, then ord, a mask stays unless a kept mask of its frame overlaps it by more than ``threshold``.

    While a frame holds more than ``lead`` masks that are undecided, its first ``lead`` are decided among themselves, as none after them
    counts, and the kept ones take away what they overlap, in all tasks. What is left, or no longer shrinks so, is decided by the pairs that overlap.
    """
    key = ["frame", "obj_id"]
    rest = stored(masks.select(*key, F.struct((-F.col("confidence")).alias("c"), "ord").alias("rank"), "runs"), "nms-masks")
    kept = None
    while True:
        full = stored(rest.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") > lead), "nms-frames")
        crowd = full.agg(F.sum("n")).first()[0]
        if not crowd:
            break
        crowded = rest.join(full.select("frame"), "frame", "left_semi")
        leaders = stored(crowded.withColumn("n", F.row_number().over(Window.partitionBy("frame").orderBy("rank"))).where(F.col("n") <= lead).drop("n"), "nms-leaders")
        stay = stored(_greedy(leaders, threshold), "nms-kept")
        kept = stay if kept is None else kept.unionByName(stay)
        others = crowded.join(leaders.select(key), key, "left_anti")
        hit = stored(_overlapped(others, leaders.join(stay, key, "left_semi"), threshold).distinct(), "nms-gone")
        gone = hit.count()
        rest = stored(rest.join(leaders.select(key).unionByName(hit), key, "left_anti"), "nms-masks")
        if gone * 10 < crowd:
            break
    last = _greedy(rest, threshold)
    return last if kept is None else kept.unionByName(last)


def run_iou(a: list, b: list) -> float:
    """IoU of two sorted lists of runs (y, x0, x1); 1 if both are empty."""
    i = j = n = 0
    while i < len(a) and j < len(b):
        (ya, a0, a1), (yb, b0, b1) = a[i], b[j]
        if ya == yb:
            n += max(0, min(a1, b1) - max(a0, b0))
        if (ya, a1) <= (yb, b1):
            i += 1
        else:
            j += 1
    union = sum(x1 - x0 for _, x0, x1 in a) + sum(x1 - x0 for _, x0, x1 in b) - n
    return n / union if union else 1.0


def temporal_filter(masks: DataFrame, least: float = 0.5) -> DataFrame:
    """(obj_id, frame) of masks that stay: valid ones whose IoU with the last kept mask of their object is at least ``least``.

    (obj_id, frame, runs, is_valid). An object's first valid mask stays; those rejected don't
    change the state, which is all that a task holds of an object beside a batch.
    """
    rows = masks.select("obj_id", "frame", F.transform(F.array_sort("runs"), lambda s: F.array(s["y"], s["x0"], s["x1"])).alias("runs"), "is_valid").repartition("obj_id").sortWithinPartitions("obj_id", "frame")
    schema = rows.select("obj_id", "frame").schema

    def run(batches):
        at, last = object(), None
        for pdf in batches:
            out = []
            for obj_id, frame, found, valid in zip(pdf["obj_id"], pdf["frame"], pdf["runs"], pdf["is_valid"], strict=True):
                if obj_id != at:
                    at, last = obj_id, None
                own = [tuple(s) for s in found]
                if valid and (last is None or run_iou(own, last) >= least):
                    last = own
                    out.append((obj_id, frame))
            yield pd.DataFrame(out, columns=["obj_id", "frame"])

    return rows.mapInPandas(run, schema)
